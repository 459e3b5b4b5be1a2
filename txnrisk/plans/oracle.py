"""SQL text of the fixture views, for the DuckDB oracle.

The same views are built with the DataFrame API in
``txnrisk.sources.fixtures``; only the base tables are registered on the
oracle side, so each oracle query starts with this WITH list.
"""

FIXTURE_CTE = """
WITH base AS (
  SELECT e.event_id AS transaction_id, e.user_id AS customer_id, e.ts AS event_time,
    CASE WHEN isnan(e.value) THEN NULL ELSE e.value END AS amount,
    CAST(regexp_extract(e.props, '[0-9]+', 0) AS INT) AS k,
    CASE CAST(floor(e.event_id / 10) AS BIGINT) % 14
      WHEN 0 THEN 'grocery' WHEN 1 THEN 'restaurant' WHEN 2 THEN 'gas' WHEN 3 THEN 'retail' WHEN 4 THEN 'online'
      WHEN 5 THEN 'entertainment' WHEN 6 THEN 'healthcare' WHEN 7 THEN 'education' WHEN 8 THEN 'utilities'
      WHEN 9 THEN 'electronics' WHEN 10 THEN 'luxury' WHEN 11 THEN 'gambling' WHEN 12 THEN 'cryptocurrency'
      ELSE 'unknown' END AS merchant_category,
    CASE e.event_type WHEN 'click' THEN 'payment' WHEN 'view' THEN 'withdrawal' WHEN 'signup' THEN 'transfer'
      ELSE 'purchase' END AS transaction_type,
    CASE WHEN e.event_id % 10 < 4 THEN 'mobile' WHEN e.event_id % 10 < 7 THEN 'web'
      WHEN e.event_id % 10 < 9 THEN 'pos' ELSE 'atm' END AS device_type,
    CAST(18 + c.c_custkey % 63 AS DOUBLE) AS age,
    CAST(20000 + (c.c_custkey * 7919) % 480001 AS DOUBLE) AS income,
    CASE WHEN c.c_acctbal IS NOT NULL THEN greatest(c.c_acctbal, CAST(100 AS DOUBLE)) END AS account_balance,
    30 + (c.c_custkey * 31) % 3620 AS account_age_days,
    CAST(300 + (c.c_custkey * 17) % 551 AS DOUBLE) AS credit_score,
    1 + c.c_custkey % 49 AS transaction_frequency
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
), located AS (
  SELECT *, CASE WHEN k < 60 THEN 'local' WHEN k < 85 THEN 'regional' WHEN k < 97 THEN 'national'
      ELSE 'international' END AS location,
    avg(amount) OVER (PARTITION BY customer_id) AS cust_avg
  FROM base
), txn AS (
  SELECT *, CASE WHEN amount >= 5 * cust_avg OR (location = 'international' AND amount > cust_avg)
      THEN 1 ELSE 0 END AS is_fraud
  FROM located
), scored AS (
  SELECT transaction_id, customer_id, event_time, amount, merchant_category, location, is_fraud,
    CASE WHEN amount IS NOT NULL AND cust_avg <> 0 THEN round(least(CAST(1 AS DOUBLE), amount / (5 * cust_avg)), 4) END AS p_amount,
    CAST(CASE WHEN location = 'international' THEN 1 ELSE 0 END AS DOUBLE) AS p_location,
    round(CASE WHEN hour(event_time) >= 22 OR hour(event_time) <= 5 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END, 4) AS p_night
  FROM txn
), orders_txn AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderdate AS event_time,
    o_totalprice / 100 AS amount FROM orders
), ens AS (
  SELECT *, round((p_amount + p_location + p_night) / 3, 4) AS p FROM scored
)
"""
