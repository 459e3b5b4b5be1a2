"""Catalogue, part 4: ensembles, policies, scoring, alerts, history and
dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import features as fx
from txnrisk.functions import policies as pol
from txnrisk.operators import dashboard, scoring
from txnrisk.operators.joins import sized_join
from txnrisk.plans.catalog_features import SQL_AMOUNT_CATEGORY, SQL_FLAGS, SQL_TIME, sql_money_avg
from txnrisk.plans.registry import query
from txnrisk.session import cut_lineage
from txnrisk.sources import fixtures
from txnrisk.sources.tables import read_table

ID = "transaction_id"
MODELS = ["p_amount", "p_location", "p_night"]


def ens_scored(spark: SparkSession, sf: str, prob: str = "p", policy: str = "strict"
               ) -> DataFrame:
    e = fixtures.ens(spark, sf)
    return scoring.combine(e, MODELS, policy=policy, prob_col=F.col(prob))


def _split_train(df: DataFrame) -> DataFrame:
    return df.where(F.substring(F.md5(F.col(ID).cast("string")), 1, 4) >= "3333")


# shared SQL --------------------------------------------------------------------
SQL_CONF = """round(CAST(1 AS DOUBLE) / (1 + ((p_amount - m3) * (p_amount - m3) + (p_location - m3) * (p_location - m3)
    + (p_night - m3) * (p_night - m3)) / 3), 6)"""


def sql_scored(prob: str = "p", policy: str = "strict") -> str:
    if policy == "strict":
        level = (f"CASE WHEN {prob} >= 0.9 THEN 'critical' WHEN {prob} >= 0.8 THEN 'high' "
                 f"WHEN {prob} >= 0.6 THEN 'medium' ELSE 'low' END")
        decide = f"coalesce({prob} >= 0.6, false)"
    else:
        level = (f"CASE WHEN {prob} >= 0.8 THEN 'critical' WHEN {prob} >= 0.6 THEN 'high' "
                 f"WHEN {prob} >= 0.3 THEN 'medium' ELSE 'low' END")
        decide = f"coalesce({prob} >= 0.3, false)"
    alert = ("risk_level IN ('high', 'critical') AND confidence_score > 0.7" if policy == "strict"
             else "risk_level IN ('high', 'critical')")
    return f"""
, es0 AS (SELECT *, {prob} AS fraud_probability, {SQL_CONF} AS confidence_score,
    {level} AS risk_level, {decide} AS is_fraud_pred
  FROM (SELECT *, (p_amount + p_location + p_night) / 3 AS m3 FROM ens))
, es AS (SELECT *, {alert} AS alert_triggered FROM es0)
"""


# --- ensembles and policies ------------------------------------------------------

@query("score_ensemble_mean", sql="SELECT transaction_id, p FROM ens")
def score_ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = fixtures.scored(spark, sf)
    return e.select(ID, F.round(pol.mean_of(MODELS), 4).alias("p"))


@query("score_ensemble_weighted", sql="""
SELECT transaction_id,
  round((p_amount * CAST(0.6 AS DOUBLE) + p_location * CAST(0.4 AS DOUBLE)) / CAST(1.0 AS DOUBLE), 6) AS p
FROM scored""")
def score_ensemble_weighted(spark: SparkSession, sf: str) -> DataFrame:
    s = fixtures.scored(spark, sf)
    return s.select(ID, F.round(pol.weighted_mean(["p_amount", "p_location"],
                                                  pol.ENSEMBLE_WEIGHTS), 6).alias("p"))


@query("score_ensemble_vote", sql="""
SELECT transaction_id,
  CASE WHEN (CAST(p_amount >= 0.5 AS DOUBLE) * CAST(0.6 AS DOUBLE)
    + CAST(p_location >= 0.5 AS DOUBLE) * CAST(0.4 AS DOUBLE)) / CAST(1.0 AS DOUBLE) > 0.5
    THEN 1 ELSE 0 END AS is_fraud_pred
FROM scored""")
def score_ensemble_vote(spark: SparkSession, sf: str) -> DataFrame:
    s = fixtures.scored(spark, sf)
    return s.select(ID, pol.weighted_vote(["p_amount", "p_location"], pol.ENSEMBLE_WEIGHTS)
                    .alias("is_fraud_pred"))


@query("score_confidence", sql=f"""
SELECT transaction_id, {SQL_CONF} AS confidence_strict, {SQL_CONF} AS confidence_dashboard
FROM (SELECT *, (p_amount + p_location + p_night) / 3 AS m3 FROM ens)""")
def score_confidence(spark: SparkSession, sf: str) -> DataFrame:
    s = fixtures.scored(spark, sf)
    return s.select(ID, F.round(pol.confidence(MODELS, "strict"), 6).alias("confidence_strict"),
                    F.round(pol.confidence(MODELS, "dashboard"), 6).alias("confidence_dashboard"))


@query("risk_level_strict", sql=sql_scored() + """
SELECT transaction_id, p, risk_level, is_fraud_pred FROM es""")
def risk_level_strict(spark: SparkSession, sf: str) -> DataFrame:
    return ens_scored(spark, sf).select(ID, "p", "risk_level", "is_fraud_pred")


@query("risk_level_sensitive", sql=sql_scored(policy="sensitive") + """
SELECT transaction_id, p, risk_level, is_fraud_pred FROM es""")
def risk_level_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    return ens_scored(spark, sf, policy="sensitive").select(ID, "p", "risk_level", "is_fraud_pred")


@query("score_minmax", sql="""
, st AS (SELECT min(amount) AS lo, max(amount) AS hi FROM scored
         WHERE substr(md5(CAST(transaction_id AS VARCHAR)), 1, 4) >= '3333')
SELECT transaction_id,
  round(CASE WHEN hi - lo = 0 THEN CAST(0 AS DOUBLE)
    ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), 1.0 - (amount - lo) / (hi - lo))) END, 6) AS score
FROM scored, st""")
def score_minmax(spark: SparkSession, sf: str) -> DataFrame:
    s = fixtures.scored(spark, sf)
    # fitted state: two numbers from the training rows, then a pure expression
    lo, hi = _split_train(s).agg(F.min("amount"), F.max("amount")).first()
    return s.select(ID, F.round(pol.minmax_inverted("amount", F.lit(lo), F.lit(hi)), 6)
                    .alias("score"))


@query("score_maxscale", sql="""
, st AS (SELECT max(amount) AS mx FROM scored
         WHERE substr(md5(CAST(transaction_id AS VARCHAR)), 1, 4) >= '3333')
SELECT transaction_id,
  round(CASE WHEN mx = 0 THEN CAST(0 AS DOUBLE)
    ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), amount / mx)) END, 6) AS score
FROM scored, st""")
def score_maxscale(spark: SparkSession, sf: str) -> DataFrame:
    s = fixtures.scored(spark, sf)
    (mx,) = _split_train(s).agg(F.max("amount")).first()
    return s.select(ID, F.round(pol.max_scaled("amount", F.lit(mx)), 6).alias("score"))


@query("model_predictions_long", sql="""
SELECT transaction_id, 'p_amount' AS model, p_amount AS probability FROM scored
UNION ALL SELECT transaction_id, 'p_location', p_location FROM scored
UNION ALL SELECT transaction_id, 'p_night', p_night FROM scored""")
def model_predictions_long(spark: SparkSession, sf: str) -> DataFrame:
    s = fixtures.scored(spark, sf).withColumn("m", pol.predictions_map(MODELS))
    return s.select(ID, F.explode("m").alias("model", "probability"))


# --- the scoring pipeline -----------------------------------------------------------

SQL_PIPELINE = """
, cs AS (SELECT customer_id, """ + sql_money_avg("amount") + """ AS cm FROM base GROUP BY customer_id)
, sc AS (SELECT t.transaction_id, t.customer_id, t.event_time,
    CASE WHEN t.amount IS NOT NULL AND cs.cm <> 0 THEN round(least(CAST(1 AS DOUBLE), t.amount / (5 * cs.cm)), 4) END AS p_amount,
    t.amount IS NULL OR t.event_time IS NULL OR cs.cm IS NULL OR cs.cm = 0 AS bad,
    CASE WHEN t.location IN ('international') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p_location,
    CASE WHEN hour(t.event_time) >= 22 OR hour(t.event_time) <= 5 THEN CAST(0.75 AS DOUBLE)
      ELSE CAST(0.25 AS DOUBLE) END AS p_night
  FROM located t LEFT JOIN cs ON t.customer_id = cs.customer_id)
, sp AS (SELECT *, round((p_amount + p_location + p_night) / 3, 4) AS p,
    (p_amount + p_location + p_night) / 3 AS m3 FROM sc)
, es0 AS (SELECT *, CASE WHEN bad THEN 0.0 ELSE p END AS fraud_probability,
    CASE WHEN bad THEN 0.0 ELSE """ + SQL_CONF + """ END AS confidence_score,
    CASE WHEN bad THEN 'error' WHEN p >= 0.9 THEN 'critical' WHEN p >= 0.8 THEN 'high' WHEN p >= 0.6 THEN 'medium'
      ELSE 'low' END AS risk_level, NOT bad AND p >= 0.6 AS is_fraud_pred FROM sp)
"""


@query("score_pipeline", sql=SQL_PIPELINE + """
SELECT transaction_id, customer_id, event_time, fraud_probability, confidence_score, risk_level,
  is_fraud_pred, risk_level IN ('high', 'critical') AND confidence_score > 0.7 AS alert_triggered
FROM es0""")
def score_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.score_pipeline(fixtures.base_txn(spark, sf))   # no label needed
    return s.select(ID, "customer_id", "event_time", "fraud_probability", "confidence_score",
                    "risk_level", "is_fraud_pred", "alert_triggered")


SPOILED_EVENTS = """(SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE ts END AS ts,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS user_id, event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE props END AS props FROM events)"""


def spoiled_txn(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions of the events with some times, customers, amounts and
    properties missing, and some amounts NaN."""
    e, i = read_table(spark, sf, "events"), F.col("event_id")
    e = e.withColumns({
        "ts": F.when(i % 13 != 0, F.col("ts")), "user_id": F.when(i % 17 != 0, F.col("user_id")),
        "value": F.when(i % 7 == 0, None).when(i % 11 == 0, float("nan")).otherwise(F.col("value")),
        "props": F.when(i % 19 != 0, F.col("props"))})
    return fixtures.events_to_txn(e, fixtures.customer_profile(spark, sf))


@query("score_spoiled_rows", events=SPOILED_EVENTS, sql=SQL_PIPELINE + """
SELECT transaction_id, fraud_probability, confidence_score, risk_level, is_fraud_pred FROM es0""")
def score_spoiled_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = scoring.score_pipeline(spoiled_txn(spark, sf))
    return s.select(ID, "fraud_probability", "confidence_score", "risk_level", "is_fraud_pred")


@query("features_spoiled_rows", events=SPOILED_EVENTS, sql="SELECT transaction_id," + SQL_TIME + "," + SQL_FLAGS + """,
  """ + SQL_AMOUNT_CATEGORY + """ AS amount_category FROM located""")
def features_spoiled_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.derive_features(spoiled_txn(spark, sf))
    return d.select(ID, *fx.TIME_FEATURES, "is_high_risk_location", "is_high_risk_merchant", "is_mobile_device",
                    "amount_category")


@query("score_invalid_rows", sql="""
, o AS (SELECT o.transaction_id, CASE WHEN o.amount > 50 THEN o.amount END AS amount,
    CASE WHEN c.c_acctbal IS NOT NULL THEN greatest(c.c_acctbal, CAST(100 AS DOUBLE)) END AS account_balance
  FROM orders_txn o LEFT JOIN customer c ON o.customer_id = c.c_custkey)
, s AS (SELECT *, round(amount / NULLIF(account_balance + amount, 0), 4) AS p FROM o)
SELECT transaction_id,
  CASE WHEN amount IS NULL OR account_balance IS NULL THEN 'error'
    WHEN p >= 0.9 THEN 'critical' WHEN p >= 0.8 THEN 'high' WHEN p >= 0.6 THEN 'medium' ELSE 'low' END
    AS risk_level,
  CASE WHEN amount IS NULL OR account_balance IS NULL THEN CAST(0 AS DOUBLE) ELSE p END AS fraud_probability
FROM s""")
def score_invalid_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = fixtures.orders_txn(spark, sf).withColumn(
        "amount", F.when(F.col("amount") > 50, F.col("amount")))
    prof = fixtures.customer_profile(spark, sf).select("customer_id", "account_balance")
    j = sized_join(o, prof, "customer_id", "left", materialize=False).withColumn(
        "p_balance", F.round(fx.balance_impact("amount", "account_balance"), 4))
    s = scoring.combine(j, ["p_balance"], prob_col=F.col("p_balance"))
    s = scoring.mark_invalid(s, ["amount", "account_balance"])
    return s.select(ID, "risk_level", "fraud_probability")


# --- alerts ---------------------------------------------------------------------------

@query("alerts_strict", sql=sql_scored("p_amount") + """
SELECT transaction_id, risk_level, p_amount AS p FROM es WHERE alert_triggered""")
def alerts_strict(spark: SparkSession, sf: str) -> DataFrame:
    s = ens_scored(spark, sf, prob="p_amount")
    return s.where(F.col("alert_triggered")).select(ID, "risk_level",
                                                    F.col("p_amount").alias("p"))


@query("alerts_dashboard", sql=sql_scored("p_amount") + """
SELECT transaction_id, risk_level, p_amount AS p FROM es WHERE risk_level IN ('high', 'critical')""")
def alerts_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    s = ens_scored(spark, sf, prob="p_amount")
    return s.where(pol.alert_dashboard("risk_level")).select(ID, "risk_level",
                                                             F.col("p_amount").alias("p"))


@query("alert_records", sql=sql_scored("p_amount") + """
SELECT 'ALERT_' || CAST(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', event_time) AS VARCHAR)
    || '_' || CAST(transaction_id AS VARCHAR) AS alert_id,
  transaction_id, CAST(customer_id AS VARCHAR) AS customer_id, risk_level, fraud_probability,
  event_time AS timestamp, confidence_score, amount AS transaction_amount, merchant_category, location
FROM es WHERE alert_triggered""")
def alert_records(spark: SparkSession, sf: str) -> DataFrame:
    s = ens_scored(spark, sf, prob="p_amount").withColumn(
        "model_predictions", pol.predictions_map(MODELS))
    a = scoring.alert_records(s)
    return a.select("alert_id", ID, "customer_id", "risk_level", "fraud_probability", "timestamp",
                    "details.confidence_score", "details.transaction_amount",
                    "details.merchant_category", "details.location")


# --- history and dashboard ---------------------------------------------------------------

SQL_HISTORY = sql_scored() + """
, h AS (SELECT transaction_id, amount, merchant_category, location, is_fraud_pred AS is_fraud,
    fraud_probability, risk_level, confidence_score, event_time AS timestamp, alert_triggered FROM es)
"""
SQL_VIEW_COLS = """transaction_id, amount, merchant_category, location, is_fraud, fraud_probability,
  risk_level, confidence_score, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
  CASE WHEN risk_level = 'critical' THEN '#ffebee' WHEN risk_level = 'high' THEN '#fff3e0'
    WHEN risk_level = 'medium' THEN '#f3e5f5' ELSE '#e8f5e8' END AS row_color"""


def _history(spark, sf):
    return dashboard.history(ens_scored(spark, sf))


@query("history_view", sql=SQL_HISTORY + f"SELECT {SQL_VIEW_COLS} FROM h")
def history_view(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.history_view(_history(spark, sf))


@query("history_filtered", sql=SQL_HISTORY + f"""
SELECT {SQL_VIEW_COLS} FROM h WHERE risk_level IN ('medium', 'high', 'critical')""")
def history_filtered(spark: SparkSession, sf: str) -> DataFrame:
    h = dashboard.filter_history(_history(spark, sf), levels=["medium", "high", "critical"])
    return dashboard.history_view(h)


@query("history_last_100", sql=SQL_HISTORY + """
SELECT transaction_id, timestamp AS event_time, risk_level FROM h
ORDER BY timestamp DESC, transaction_id DESC LIMIT 100""")
def history_last_100(spark: SparkSession, sf: str) -> DataFrame:
    s = ens_scored(spark, sf)
    return dashboard.last_n(s, 100).select(ID, "event_time", "risk_level")


def _alert_rows(spark, sf):
    s = ens_scored(spark, sf, prob="p_amount")
    return s.where(pol.alert_dashboard("risk_level"))


@query("alerts_last_50", sql=sql_scored("p_amount") + """
SELECT transaction_id, event_time, risk_level FROM es WHERE risk_level IN ('high', 'critical')
ORDER BY event_time DESC, transaction_id DESC LIMIT 50""")
def alerts_last_50(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.last_n(_alert_rows(spark, sf), 50).select(ID, "event_time", "risk_level")


@query("alerts_last_10", sql=sql_scored("p_amount") + """
SELECT transaction_id, event_time, risk_level,
  CASE WHEN risk_level = 'critical' THEN 'CRITICAL ALERT' ELSE 'HIGH RISK ALERT' END AS banner,
  round(amount, 2) AS amount, round(fraud_probability, 3) AS fraud_probability
FROM es WHERE risk_level IN ('high', 'critical')
ORDER BY event_time DESC, transaction_id DESC LIMIT 10""")
def alerts_last_10(spark: SparkSession, sf: str) -> DataFrame:
    a = dashboard.last_n(_alert_rows(spark, sf), 10)
    return a.select(ID, "event_time", "risk_level", pol.alert_banner("risk_level").alias("banner"),
                    F.round("amount", 2).alias("amount"),
                    F.round("fraud_probability", 3).alias("fraud_probability"))


@query("dash_metrics", sql=SQL_HISTORY + """
SELECT count(*) AS total, count(*) FILTER (WHERE is_fraud) AS fraud_count,
  round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_fraud) * 100.0 / count(*) ELSE 0 END, 6)
    AS fraud_rate_pct,
  count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS high_risk,
  round(avg(fraud_probability), 6) AS avg_p
FROM h""")
def dash_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.metrics(_history(spark, sf))


@query("dash_risk_distribution", sql=SQL_HISTORY + """
SELECT risk_level, count(*) AS n FROM h GROUP BY risk_level""")
def dash_risk_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.risk_distribution(_history(spark, sf))


@query("dash_last10_fraud", sql=SQL_HISTORY + """
SELECT count(*) FILTER (WHERE is_fraud) AS n_fraud FROM
  (SELECT * FROM h ORDER BY timestamp DESC, transaction_id DESC LIMIT 10)""")
def dash_last10_fraud(spark: SparkSession, sf: str) -> DataFrame:
    s = dashboard.last_n(ens_scored(spark, sf), 10)
    return s.agg(F.count_if(F.col("is_fraud_pred")).alias("n_fraud"))


@query("dash_probability_series", sql=SQL_HISTORY + """
SELECT date_trunc('day', timestamp) AS day, is_fraud AS is_fraud_pred,
  round(avg(fraud_probability), 6) AS avg_p, count(*) AS n
FROM h GROUP BY 1, 2""")
def dash_probability_series(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.probability_series(_history(spark, sf))


@query("stats_running", sql=SQL_HISTORY + """
SELECT count(*) AS total_transactions, count(*) FILTER (WHERE is_fraud) AS fraud_detected,
  count(*) FILTER (WHERE alert_triggered) AS alerts_triggered FROM h""")
def stats_running(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.running_stats(ens_scored(spark, sf))


@query("fraud_by_window", sql="""
SELECT date_trunc('day', event_time) AS window_start, count(*) AS n,
  CAST(sum(is_fraud) AS BIGINT) AS n_fraud FROM txn GROUP BY 1""")
def fraud_by_window(spark: SparkSession, sf: str) -> DataFrame:
    t = fixtures.txn(spark, sf)
    return (t.groupBy(F.window("event_time", "1 day").start.alias("window_start"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").cast("bigint").alias("n_fraud")))


@query("dash_risk_ranked", sql=SQL_HISTORY + """
SELECT risk_level, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, risk_level) AS INTEGER) AS place FROM h GROUP BY risk_level""")
def dash_risk_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.risk_ranked(_history(spark, sf))


@query("dash_series_points", sql=SQL_HISTORY + """
, b AS (SELECT *, time_bucket(INTERVAL 6 HOUR, timestamp, TIMESTAMP '1970-01-01') AS bucket FROM h WHERE timestamp IS NOT NULL AND fraud_probability IS NOT NULL),
r AS (SELECT *, row_number() OVER (w ORDER BY timestamp, transaction_id) AS first, row_number() OVER (w ORDER BY timestamp DESC, transaction_id) AS last,
    row_number() OVER (w ORDER BY fraud_probability, timestamp, transaction_id) AS least,
    row_number() OVER (w ORDER BY fraud_probability DESC, timestamp, transaction_id) AS most
  FROM b WINDOW w AS (PARTITION BY bucket, is_fraud))
SELECT bucket, is_fraud, transaction_id, timestamp, fraud_probability,
  concat_ws(',', CASE WHEN first = 1 THEN 'first' END, CASE WHEN last = 1 THEN 'last' END, CASE WHEN least = 1 THEN 'least' END,
    CASE WHEN most = 1 THEN 'most' END) AS kinds
FROM r WHERE first = 1 OR last = 1 OR least = 1 OR most = 1""")
def dash_series_points(spark: SparkSession, sf: str) -> DataFrame:
    """Fraud probability over time, row by row, in as few points as draw the same line."""
    p = dashboard.series_points(_history(spark, sf), "6 hours")
    return p.withColumn("kinds", F.array_join("kinds", ","))


PAGE_ROWS = 40


@query("history_pages", sql=SQL_HISTORY + f"""
SELECT transaction_id, CAST((n - 1) // {PAGE_ROWS} AS INTEGER) AS page FROM (
  SELECT transaction_id, row_number() OVER (ORDER BY fraud_probability DESC NULLS LAST, transaction_id) AS n FROM h) WHERE n <= 3 * {PAGE_ROWS}""")
def history_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages of the history by falling probability, each found from the last row of the one before."""
    hist = cut_lineage(_history(spark, sf), "history")
    out, after = None, None
    for i in range(3):
        rows = cut_lineage(dashboard.page(hist, "fraud_probability", PAGE_ROWS, after, descending=True), "page")
        last = rows.orderBy(F.col("fraud_probability").asc_nulls_first(), F.desc(ID)).first()      # of a page
        part = rows.select(ID, F.lit(i).alias("page"))
        out = part if out is None else out.unionByName(part)
        if last is None:
            break
        after = (last["fraud_probability"], last[ID])
    return out


@query("score_confidence_small", sql="""
SELECT transaction_id, CAST(1 AS DOUBLE) AS one_strict, CAST(0.5 AS DOUBLE) AS one_dashboard, CAST(0 AS DOUBLE) AS none_strict,
  CAST(0.5 AS DOUBLE) AS none_dashboard, CAST(0 AS DOUBLE) AS none_mean FROM scored WHERE p_amount IS NOT NULL""")
def score_confidence_small(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement where a single model, or none, has scored."""
    s = fixtures.scored(spark, sf).where(F.col("p_amount").isNotNull())
    return s.select(ID, pol.confidence(MODELS[:1]).alias("one_strict"), pol.confidence(MODELS[:1], "dashboard").alias("one_dashboard"),
                    pol.confidence([]).alias("none_strict"), pol.confidence([], "dashboard").alias("none_dashboard"), pol.mean_of([]).alias("none_mean"))


@query("alert_details", sql=sql_scored("p_amount") + """
SELECT transaction_id, round(amount, 4) AS transaction_amount, merchant_category, location, round(confidence_score, 6) AS confidence_score,
  p_amount, p_location, p_night FROM es WHERE alert_triggered""")
def alert_details(spark: SparkSession, sf: str) -> DataFrame:
    """The alert's details, read back from their JSON text."""
    s = ens_scored(spark, sf, prob="p_amount").withColumn("model_predictions", pol.predictions_map(MODELS))
    schema = ("model_predictions map<string,double>, confidence_score double, transaction_amount double, "
              "merchant_category string, location string")
    d = scoring.alert_records(s).select(ID, F.from_json("details_json", schema).alias("d"))
    return d.select(ID, F.round("d.transaction_amount", 4).alias("transaction_amount"), "d.merchant_category", "d.location",
                    F.round("d.confidence_score", 6).alias("confidence_score"), *[F.col("d.model_predictions")[m].alias(m) for m in MODELS])
