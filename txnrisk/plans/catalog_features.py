"""Catalogue, part 1: sources, projections, filters, join, features, rules."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import features as fx
from txnrisk.operators import keyed, rules
from txnrisk.plans.registry import query
from txnrisk.sources import files
from txnrisk.sources.fixtures import base_txn, customer_profile, orders_txn, txn
from txnrisk.sources.tables import read_table

ID = "transaction_id"

FEATURES_24 = [
    "amount", "age", "income", "account_balance", "account_age_days", "credit_score",
    "transaction_frequency", "amount_to_income_ratio", "amount_to_balance_ratio", "hour",
    "day_of_week", "is_weekend", "is_night", "is_business_hours", "log_amount",
    "balance_impact", "is_high_risk_location", "is_high_risk_merchant", "is_mobile_device",
    "customer_transaction_count", "customer_avg_amount", "customer_amount_std",
    "amount_deviation", "is_amount_above_avg"]
DOUBLE_FEATURES = {"amount", "age", "income", "account_balance", "credit_score",
                   "amount_to_income_ratio", "amount_to_balance_ratio", "log_amount",
                   "balance_impact", "customer_amount_std", "amount_deviation"}


def r6(x, name=None):
    col = F.round(fx.c(x), 6)
    return col.alias(name or x) if isinstance(x, str) or name else col


# SQL fragments shared by the oracles ------------------------------------------
def sql_money_avg(x: str, over: str = "") -> str:
    """Exact mean of 8-decimal money, HALF_UP at 8 places (integer arithmetic)."""
    s = f"CAST(sum(CAST({x} AS DECIMAL(28,8))) {over} * 100000000 AS HUGEINT)"
    n = f"NULLIF(count({x}) {over}, 0)"
    return f"(CAST(({s} * 2 + {n}) // (2 * {n}) AS DOUBLE) / 100000000)"


SQL_TIME = """
  CAST(hour(event_time) AS INTEGER) AS hour,
  CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
  CASE WHEN isodow(event_time) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(event_time) >= 22 OR hour(event_time) <= 5 THEN 1 ELSE 0 END AS is_night,
  CASE WHEN hour(event_time) BETWEEN 9 AND 17 THEN 1 ELSE 0 END AS is_business_hours"""
SQL_RATIOS = """
  round(amount / NULLIF(income / 12, 0), 6) AS amount_to_income_ratio,
  round(amount / NULLIF(account_balance, 0), 6) AS amount_to_balance_ratio,
  round(amount / NULLIF(account_balance + amount, 0), 6) AS balance_impact"""
SQL_FLAGS = """
  CASE WHEN location IN ('international') THEN 1 ELSE 0 END AS is_high_risk_location,
  CASE WHEN merchant_category IN ('electronics', 'luxury', 'gambling', 'cryptocurrency', 'unknown')
    THEN 1 ELSE 0 END AS is_high_risk_merchant,
  CASE WHEN device_type = 'mobile' THEN 1 ELSE 0 END AS is_mobile_device"""
SQL_AMOUNT_CATEGORY = """CASE WHEN amount <= 0 THEN NULL WHEN amount <= 50 THEN 'very_low'
    WHEN amount <= 200 THEN 'low' WHEN amount <= 500 THEN 'medium' WHEN amount <= 2000 THEN 'high'
    WHEN amount IS NOT NULL THEN 'very_high' END"""
SQL_CUST_STATS = """
, cs AS (SELECT customer_id, count(amount) AS customer_transaction_count,
    """ + sql_money_avg("amount") + """ AS customer_avg_amount, stddev_samp(amount) AS customer_amount_std
  FROM {src} WHERE customer_id IS NOT NULL GROUP BY customer_id)
, fs AS (SELECT s.*, cs.customer_transaction_count, cs.customer_avg_amount, cs.customer_amount_std,
    (s.amount - cs.customer_avg_amount) / (cs.customer_amount_std + 1) AS amount_deviation,
    CASE WHEN s.amount > cs.customer_avg_amount THEN 1 ELSE 0 END AS is_amount_above_avg
  FROM {src} s LEFT JOIN cs ON s.customer_id = cs.customer_id)
"""


# --- sources and join ---------------------------------------------------------

@query("join_customer_profile", sql="""
SELECT transaction_id, customer_id, amount, age, income, account_balance FROM base""")
def join_customer_profile(spark: SparkSession, sf: str) -> DataFrame:
    return base_txn(spark, sf).select(ID, "customer_id", "amount", "age", "income",
                                      "account_balance")


@query("src_csv_roundtrip", sql="""
SELECT transaction_id, customer_id, amount, merchant_category FROM txn""")
def src_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = os.path.join(files.shared_dir(spark), f"csv-roundtrip-{uuid.uuid4().hex}")
    t = txn(spark, sf).select(ID, "customer_id", "amount", "merchant_category")
    files.write_csv(t, path)
    return files.read_csv(spark, path, files.schema_of(t))


@query("union_by_name", sql="""
SELECT transaction_id, is_fraud, CAST(NULL AS VARCHAR) AS fraud_type FROM txn WHERE is_fraud = 0
UNION ALL
SELECT transaction_id, is_fraud,
  CASE WHEN amount >= 5 * cust_avg THEN 'high_amount' ELSE 'unusual_location' END AS fraud_type
FROM txn WHERE is_fraud = 1""")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    t = txn(spark, sf)
    normal = t.where(F.col("is_fraud") == 0).select(ID, "is_fraud")
    fraud = t.where(F.col("is_fraud") == 1).select(
        ID, "is_fraud",
        F.when(F.col("amount") >= 5 * F.col("cust_avg"), "high_amount")
        .otherwise("unusual_location").alias("fraud_type"))
    return normal.unionByName(fraud, allowMissingColumns=True)


# --- filters ------------------------------------------------------------------

@query("filter_normal_rows", sql="""
SELECT transaction_id, amount FROM txn
WHERE is_fraud = 0 OR NOT EXISTS (SELECT 1 FROM txn WHERE is_fraud = 0)""")
def filter_normal_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = txn(spark, sf).select(ID, "amount", "is_fraud")
    normal = t.where(F.col("is_fraud") == 0)
    # bounded action: stops at the first normal row
    keep = normal if normal.limit(1).count() > 0 else t
    return keep.select(ID, "amount")


VALID_BOUNDS = {  # fixed values: entry-form bounds
    "amount": (0.01, 100000.0), "age": (18.0, 100.0), "income": (20000.0, 1000000.0),
    "account_balance": (100.0, 1000000.0)}


@query("validate_txn", sql="""
, v AS (
  SELECT o.transaction_id,
    CASE WHEN o.amount IS NULL OR o.amount < 0.01 OR o.amount > 100000 THEN 'amount' END AS r1,
    CASE WHEN p.age IS NULL OR p.age < 18 OR p.age > 100 THEN 'age' END AS r2,
    CASE WHEN p.income IS NULL OR p.income < 20000 OR p.income > 1000000 THEN 'income' END AS r3,
    CASE WHEN c.c_acctbal IS NULL OR c.c_acctbal < 100 OR c.c_acctbal > 1000000
      THEN 'account_balance' END AS r4
  FROM orders_txn o
  LEFT JOIN customer c ON o.customer_id = c.c_custkey
  LEFT JOIN (SELECT c_custkey, CAST(18 + c_custkey % 63 AS DOUBLE) AS age,
               CAST(20000 + (c_custkey * 7919) % 480001 AS DOUBLE) AS income FROM customer) p
    ON o.customer_id = p.c_custkey)
SELECT transaction_id,
  CAST((r1 IS NOT NULL)::INT + (r2 IS NOT NULL)::INT + (r3 IS NOT NULL)::INT + (r4 IS NOT NULL)::INT AS INTEGER) AS n_reasons,
  (r1 IS NULL AND r2 IS NULL AND r3 IS NULL AND r4 IS NULL) AS is_valid,
  concat_ws(',', r1, r2, r3, r4) AS reasons
FROM v""")
def validate_txn(spark: SparkSession, sf: str) -> DataFrame:
    o = orders_txn(spark, sf)
    raw = customer_profile(spark, sf, raw_balance=True).select("customer_id", "age", "income", "account_balance")
    j = keyed.attach(o, raw, "customer_id")
    reasons = []
    for name, (lo, hi) in VALID_BOUNDS.items():
        v = F.col(name)
        reasons.append(F.when(v.isNull() | (v < lo) | (v > hi), F.lit(name)))
    arr = F.filter(F.array(*reasons), lambda x: x.isNotNull())
    return j.select(ID, F.size(arr).alias("n_reasons"), (F.size(arr) == 0).alias("is_valid"),
                    F.array_join(arr, ",").alias("reasons"))


CATEGORY_DOMAINS = {  # fixed values: entry-form choices
    "merchant_category": ["grocery", "restaurant", "gas", "retail", "online", "entertainment", "healthcare", "education", "utilities",
                          "electronics", "luxury", "gambling", "cryptocurrency", "unknown"],
    "location": ["local", "regional", "national", "international"],
    "transaction_type": ["purchase", "withdrawal", "transfer", "payment"],
    "device_type": ["mobile", "web", "pos", "atm"]}


@query("validate_categories", sql="""
, e AS (SELECT transaction_id, CASE WHEN transaction_id % 31 = 4 THEN 'bookshop' ELSE merchant_category END AS m,
    CASE WHEN transaction_id % 37 <> 5 THEN location END AS l, CASE WHEN transaction_id % 41 = 6 THEN upper(transaction_type) ELSE transaction_type END AS t,
    CASE WHEN transaction_id % 43 = 7 THEN '' ELSE device_type END AS d FROM located)
SELECT transaction_id, concat_ws(',', CASE WHEN m = 'bookshop' THEN 'merchant_category' END, CASE WHEN l IS NULL THEN 'location' END,
  CASE WHEN t <> lower(t) THEN 'transaction_type' END, CASE WHEN d = '' THEN 'device_type' END) AS reasons FROM e""")
def validate_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Entries outside the form's choices: some unknown, missing, in other case or empty."""
    i = F.col(ID)
    t = base_txn(spark, sf).withColumns({
        "merchant_category": F.when(i % 31 == 4, "bookshop").otherwise(F.col("merchant_category")),
        "location": F.when(i % 37 != 5, F.col("location")),
        "transaction_type": F.when(i % 41 == 6, F.upper("transaction_type")).otherwise(F.col("transaction_type")),
        "device_type": F.when(i % 43 == 7, "").otherwise(F.col("device_type"))})
    reasons = F.array(*[F.when(F.col(c).isNull() | ~F.col(c).isin(*d), F.lit(c)) for c, d in CATEGORY_DOMAINS.items()])
    return t.select(ID, F.array_join(F.filter(reasons, lambda x: x.isNotNull()), ",").alias("reasons"))


# --- clamp / aggregates -------------------------------------------------------

@query("clamp_profile", sql="""
SELECT c_custkey,
  CASE WHEN c_acctbal IS NOT NULL THEN greatest(c_acctbal, CAST(100 AS DOUBLE)) END AS account_balance,
  least(greatest(CAST(18 + c_custkey % 63 AS DOUBLE), 18.0), 80.0) AS age,
  least(greatest(CAST(20000 + (c_custkey * 7919) % 480001 AS DOUBLE), 20000.0), 500000.0) AS income,
  least(greatest(CAST(300 + (c_custkey * 17) % 551 AS DOUBLE), 300.0), 850.0) AS credit_score
FROM customer""")
def clamp_profile(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        "c_custkey",
        fx.clamp("c_acctbal", lo=100.0).alias("account_balance"),
        fx.clamp((18 + k % 63).cast("double"), 18.0, 80.0).alias("age"),
        fx.clamp((20000 + (k * 7919) % 480001).cast("double"), 20000.0, 500000.0).alias("income"),
        fx.clamp((300 + (k * 17) % 551).cast("double"), 300.0, 850.0).alias("credit_score"))


@query("agg_customer_stats", sql=f"""
SELECT customer_id, count(amount) AS n, {sql_money_avg("amount")} AS avg_amount,
  round(stddev_samp(amount), 6) AS std_amount
FROM orders_txn GROUP BY customer_id""")
def agg_customer_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = keyed.key_stats(orders_txn(spark, sf), "customer_id", "amount", "n", "avg_amount",
                        "std_amount")
    return s.select("customer_id", "n", "avg_amount", r6("std_amount"))


@query("agg_fraud_ratio", sql="""
SELECT count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, round(avg(is_fraud), 6) AS fraud_ratio
FROM txn""")
def agg_fraud_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return txn(spark, sf).agg(F.count(F.lit(1)).alias("n"),
                              F.sum("is_fraud").cast("bigint").alias("n_fraud"),
                              F.round(F.avg("is_fraud"), 6).alias("fraud_ratio"))


@query("agg_label_dist", sql="SELECT is_fraud, count(*) AS n FROM txn GROUP BY is_fraud")
def agg_label_dist(spark: SparkSession, sf: str) -> DataFrame:
    return txn(spark, sf).groupBy("is_fraud").agg(F.count(F.lit(1)).alias("n"))


CATEGORY_DIMS = ["merchant_category", "location", "transaction_type", "device_type"]


@query("fraud_rate_by_category", sql="""
, long AS (
  SELECT 'merchant_category' AS dim, merchant_category AS value, is_fraud FROM txn
  UNION ALL SELECT 'location', location, is_fraud FROM txn
  UNION ALL SELECT 'transaction_type', transaction_type, is_fraud FROM txn
  UNION ALL SELECT 'device_type', device_type, is_fraud FROM txn)
SELECT dim, value, count(*) AS n, round(avg(is_fraud), 6) AS fraud_rate FROM long GROUP BY dim, value""")
def fraud_rate_by_category(spark: SparkSession, sf: str) -> DataFrame:
    # one scan, one shuffle: every row emits (dim, value) for each dimension and
    # the aggregate is partial on the map side
    t = txn(spark, sf)
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value"))
                      for d in CATEGORY_DIMS])
    long = t.select(F.inline(pairs), "is_fraud")
    return long.groupBy("dim", "value").agg(F.count(F.lit(1)).alias("n"),
                                            F.round(F.avg("is_fraud"), 6).alias("fraud_rate"))


# --- features -----------------------------------------------------------------

@query("feat_time", sql=f"SELECT transaction_id, {SQL_TIME} FROM txn")
def feat_time(spark: SparkSession, sf: str) -> DataFrame:
    ts = "event_time"
    return base_txn(spark, sf).select(
        ID, fx.hour_of(ts).alias("hour"), fx.day_of_week(ts).alias("day_of_week"),
        fx.is_weekend(ts).alias("is_weekend"), fx.is_night(ts).alias("is_night"),
        fx.is_business_hours(ts).alias("is_business_hours"))


@query("feat_amount", sql="SELECT transaction_id, round(ln(1 + amount), 6) AS log_amount FROM txn")
def feat_amount(spark: SparkSession, sf: str) -> DataFrame:
    return base_txn(spark, sf).select(ID, r6(fx.log_amount("amount"), "log_amount"))


@query("feat_amount_category", sql=f"""
SELECT transaction_id, {SQL_AMOUNT_CATEGORY} AS amount_category FROM orders_txn""")
def feat_amount_category(spark: SparkSession, sf: str) -> DataFrame:
    return orders_txn(spark, sf).select(ID, fx.amount_category("amount").alias("amount_category"))


@query("feat_ratios", sql=f"SELECT transaction_id, {SQL_RATIOS} FROM txn")
def feat_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return base_txn(spark, sf).select(
        ID, r6(fx.amount_to_income_ratio("amount", "income"), "amount_to_income_ratio"),
        r6(fx.amount_to_balance_ratio("amount", "account_balance"), "amount_to_balance_ratio"),
        r6(fx.balance_impact("amount", "account_balance"), "balance_impact"))


@query("feat_risk_flags", sql=f"SELECT transaction_id, {SQL_FLAGS} FROM txn")
def feat_risk_flags(spark: SparkSession, sf: str) -> DataFrame:
    return base_txn(spark, sf).select(
        ID, fx.is_high_risk_location("location").alias("is_high_risk_location"),
        fx.is_high_risk_merchant("merchant_category").alias("is_high_risk_merchant"),
        fx.is_mobile_device("device_type").alias("is_mobile_device"))


def _orders_with_stats(spark, sf):
    return keyed.attach_key_stats(orders_txn(spark, sf), "customer_id", "amount",
                                  *fx.CUSTOMER_FEATURES)


@query("feat_customer_stats", sql=SQL_CUST_STATS.format(src="orders_txn") + """
SELECT transaction_id, customer_transaction_count, customer_avg_amount,
  round(customer_amount_std, 6) AS customer_amount_std FROM fs""")
def feat_customer_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _orders_with_stats(spark, sf).select(
        ID, "customer_transaction_count", "customer_avg_amount", r6("customer_amount_std"))


@query("feat_deviation", sql=SQL_CUST_STATS.format(src="orders_txn") + """
SELECT transaction_id, round(amount_deviation, 6) AS amount_deviation, is_amount_above_avg FROM fs""")
def feat_deviation(spark: SparkSession, sf: str) -> DataFrame:
    d = _orders_with_stats(spark, sf)
    return d.select(
        ID, r6(fx.amount_deviation("amount", "customer_avg_amount", "customer_amount_std"),
               "amount_deviation"),
        fx.is_amount_above_avg("amount", "customer_avg_amount").alias("is_amount_above_avg"))


@query("feat_profile_asof", sql=f"""
SELECT transaction_id,
  count(amount) OVER w AS n_before,
  {sql_money_avg("amount", "OVER w")} AS avg_before,
  round(stddev_samp(amount) OVER w, 6) AS std_before
FROM txn
WINDOW w AS (PARTITION BY customer_id ORDER BY event_time, transaction_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def feat_profile_asof(spark: SparkSession, sf: str) -> DataFrame:
    t = base_txn(spark, sf).select(ID, "customer_id", "event_time", "amount")
    a = keyed.asof_stats(t, "customer_id", "event_time", ID, "amount", unit="hour")
    return a.select(ID, "n_before", "avg_before", r6("std_before"))


def features_24(spark: SparkSession, sf: str) -> DataFrame:
    return fx.derive_features(base_txn(spark, sf))


@query("features_full", sql=SQL_CUST_STATS.format(src="txn") + f"""
SELECT transaction_id, round(amount, 6) AS amount, round(age, 6) AS age, round(income, 6) AS income,
  round(account_balance, 6) AS account_balance, account_age_days, round(credit_score, 6) AS credit_score,
  transaction_frequency,
  round(amount / NULLIF(income / 12, 0), 6) AS amount_to_income_ratio,
  round(amount / NULLIF(account_balance, 0), 6) AS amount_to_balance_ratio,
  {SQL_TIME},
  round(ln(1 + amount), 6) AS log_amount,
  round(amount / NULLIF(account_balance + amount, 0), 6) AS balance_impact,
  {SQL_FLAGS},
  customer_transaction_count, customer_avg_amount,
  round(customer_amount_std, 6) AS customer_amount_std, round(amount_deviation, 6) AS amount_deviation,
  is_amount_above_avg
FROM fs""")
def features_full(spark: SparkSession, sf: str) -> DataFrame:
    f = features_24(spark, sf)
    return f.select(ID, *[r6(c) if c in DOUBLE_FEATURES else F.col(c) for c in FEATURES_24])


# --- rules --------------------------------------------------------------------

SQL_RULE_BASE = """
, m AS (SELECT customer_id, avg(amount) AS cm FROM txn WHERE customer_id IS NOT NULL GROUP BY customer_id)
, fu AS (SELECT transaction_id,
    row_number() OVER (PARTITION BY customer_id, merchant_category ORDER BY event_time, transaction_id) AS rn_cat,
    row_number() OVER (PARTITION BY customer_id ORDER BY event_time, transaction_id) AS rn_all
  FROM txn WHERE customer_id IS NOT NULL)
, r AS (
  SELECT t.transaction_id, t.customer_id, t.amount,
    CASE WHEN t.amount >= 5 * m.cm THEN 1 ELSE 0 END AS high_amount,
    CASE WHEN t.customer_id IS NOT NULL AND count(*) OVER (PARTITION BY t.customer_id ORDER BY t.event_time
      RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) >= 3 THEN 1 ELSE 0 END AS rapid_sequence,
    CASE WHEN t.location = 'international' THEN 1 ELSE 0 END AS unusual_location,
    CASE WHEN hour(t.event_time) BETWEEN 2 AND 5 THEN 1 ELSE 0 END AS unusual_time,
    CASE WHEN t.merchant_category IN ('electronics', 'luxury', 'gambling', 'cryptocurrency', 'unknown')
      OR (fu.rn_cat = 1 AND fu.rn_all > 1) THEN 1 ELSE 0 END AS new_merchant,
    CASE WHEN t.amount >= 2 * m.cm AND t.merchant_category IN
      ('electronics', 'luxury', 'gambling', 'cryptocurrency', 'unknown') THEN 1 ELSE 0 END AS account_takeover
  FROM txn t LEFT JOIN m ON t.customer_id = m.customer_id
  LEFT JOIN fu ON t.transaction_id = fu.transaction_id)
"""


def _rule_query(rule: str):
    @query(f"rule_{rule}", sql=SQL_RULE_BASE + f"""
SELECT transaction_id, customer_id, amount FROM r WHERE {rule} = 1""")
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return rules.rule_hits(base_txn(spark, sf), rule)
    return build


for _r in rules.RULES:
    _rule_query(_r)


@query("rule_hits", sql=SQL_RULE_BASE + """
SELECT transaction_id, high_amount, rapid_sequence, unusual_location, unusual_time, new_merchant,
  account_takeover,
  high_amount + rapid_sequence + unusual_location + unusual_time + new_merchant + account_takeover AS n_hits
FROM r""")
def rule_hits(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.apply_rules(base_txn(spark, sf))
    return out.select(ID, *rules.RULES, "n_hits")
