"""Catalogue, part 7: the detector over submitted records.  The events arrive
in four rounds by date, as JSON lines: some a round late, some twice, some cut
off, some without a time or an amount; the stream is drained after each."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.operators import dashboard
from txnrisk.plans.registry import query
from txnrisk.session import cut_lineage
from txnrisk.sources import fixtures
from txnrisk.sources.tables import read_table, table_path
from txnrisk.streaming import detector as det
from txnrisk.streaming import pipeline as sp

ID = "transaction_id"
ROUNDS, DAYS = 4, 8
DELAY = "1 day"


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    """``(round, line)``: what arrives in which round."""
    tx = fixtures.events_to_txn(read_table(spark, sf, "events"), fixtures.customer_profile(spark, sf).select("customer_id"))
    i = F.col(ID)
    first = F.least(F.lit(ROUNDS - 1), F.floor((F.dayofmonth("event_time") - 1) / DAYS)).cast("int")
    tx = tx.withColumn("_first", first).withColumn("_first", F.when(i % 97 == 5, F.least(F.lit(ROUNDS - 1), F.col("_first") + 1)).otherwise(F.col("_first")))
    none = F.array().cast("array<int>")
    rounds = F.concat(F.array("_first"), F.when(i % 41 == 7, F.array("_first")).otherwise(none),
                      F.when((i % 83 == 11) & (F.col("_first") < ROUNDS - 1), F.array(F.col("_first") + 1)).otherwise(none))
    tx = tx.withColumns({"round": F.explode(rounds), "timestamp": F.when(i % 61 != 9, F.col("event_time")),
                         "amount": F.when(i % 71 != 13, F.col("amount"))})
    line = F.to_json(F.struct(*[f.name for f in det.FIELDS]), {"timestampNTZFormat": det.TIME_FORMAT})
    return tx.select("round", F.when(i % 53 == 3, F.substring(line, F.lit(1), F.length(line) - 10)).otherwise(line).alias("line"))


# runs of the same application share the drained stream
_DRAINED: dict[tuple, det.Detector] = {}


def drained(spark: SparkSession, sf: str) -> det.Detector:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path(sf, "events"))
    changed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, sf, changed)
    if key not in _DRAINED:
        d = det.Detector(spark, sp.stream_dir(spark, "detector"), fixtures.customer_profile(spark, sf), delay=DELAY)
        lines = cut_lineage(submissions(spark, sf), "submissions")      # joined once, not in every round
        for r in range(ROUNDS):
            det.submit_lines(lines.where(F.col("round") == r).select("line"), d.inbox)
            with sp.state_partitions(spark):
                d.drain()
        _DRAINED[key] = d
    return _DRAINED[key]


SQL_ROUTES = f"""
, sent AS (SELECT b.* REPLACE (CASE WHEN transaction_id % 61 <> 9 THEN event_time END AS event_time,
      CASE WHEN transaction_id % 71 <> 13 THEN amount END AS amount), unnest(
    [least({ROUNDS - 1}, f)] || CASE WHEN transaction_id % 41 = 7 THEN [least({ROUNDS - 1}, f)] ELSE [] END ||
    CASE WHEN transaction_id % 83 = 11 AND f < {ROUNDS - 1} THEN [f + 1] ELSE [] END) AS round
  FROM (SELECT *, least({ROUNDS - 1}, (day(event_time) - 1) // {DAYS} + CASE WHEN transaction_id % 97 = 5 THEN 1 ELSE 0 END) AS f FROM located) b),
judged AS (SELECT *, transaction_id % 53 = 3 AS broken, transaction_id % 53 = 3 OR amount IS NULL AS bad FROM sent),
tops AS (SELECT round, max(max(event_time) FILTER (NOT bad)) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - INTERVAL {DELAY} AS watermark FROM judged GROUP BY round),
marked AS (SELECT j.*, CASE WHEN bad THEN 'error' WHEN event_time < watermark THEN 'late' END AS r FROM judged j JOIN tops USING (round)),
routes AS (SELECT *, coalesce(r, CASE WHEN row_number() OVER (PARTITION BY transaction_id, r ORDER BY round) > 1 THEN 'duplicate' ELSE 'scored' END) AS route
  FROM marked)
"""

SQL_JUDGED = SQL_ROUTES + """
, h AS (SELECT *, CASE WHEN customer_id IS NOT NULL THEN count(amount) OVER w END AS n_before,
    CASE WHEN customer_id IS NOT NULL THEN avg(amount) OVER w END AS avg_before
  FROM routes WHERE route = 'scored'
  WINDOW w AS (PARTITION BY customer_id ORDER BY round, event_time NULLS LAST, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
parts AS (SELECT *, CASE WHEN avg_before <> 0 THEN round(least(CAST(1 AS DOUBLE), amount / (5 * avg_before)), 4) ELSE 0 END AS a,
    CASE WHEN location = 'international' THEN CAST(1 AS DOUBLE) ELSE 0 END AS l,
    CASE WHEN hour(event_time) >= 22 OR hour(event_time) <= 5 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS n FROM h WHERE event_time IS NOT NULL),
judgement AS (SELECT *, round((a + l + n) / 3, 4) AS p,
    1 / (1 + ((a - (a + l + n) / 3) ** 2 + (l - (a + l + n) / 3) ** 2 + (n - (a + l + n) / 3) ** 2) / 3) AS confidence FROM parts)
"""


@query("stream_routes", sql=SQL_ROUTES + """
SELECT round AS batch_id, CASE WHEN NOT broken THEN transaction_id END AS transaction_id, route,
  CASE WHEN broken THEN 'unreadable' WHEN amount IS NULL THEN 'no amount' END AS reason, count(*) AS n
FROM routes GROUP BY ALL""")
def stream_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Where each submitted record ended: scored, duplicate, late or error."""
    routed = drained(spark, sf).table("routed")
    known = F.when(F.col("reason").isNull() | (F.col("reason") != "unreadable"), F.col(ID))
    return routed.groupBy("batch_id", known.alias(ID), "route", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("stream_judged", sql=SQL_JUDGED + """
SELECT transaction_id, round AS batch_id, n_before, p, CASE WHEN p >= 0.9 THEN 'critical' WHEN p >= 0.8 THEN 'high'
  WHEN p >= 0.6 THEN 'medium' ELSE 'low' END AS risk_level, p >= 0.8 AND confidence > 0.7 AS alert_triggered FROM judgement""")
def stream_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Scored records that carry a time, with the customer's history over all
    batches before them (records without one get that of their arrival)."""
    return drained(spark, sf).table("scored").where("has_time").select(
        ID, "batch_id", "n_before", F.col("fraud_probability").alias("p"), "risk_level", "alert_triggered")


@query("stream_alert_table", sql=SQL_JUDGED + """
SELECT 'ALERT_' || CAST(floor(epoch(event_time)) AS BIGINT) || '_' || transaction_id AS alert_id, transaction_id, round AS batch_id,
  p AS fraud_probability FROM judgement WHERE p >= 0.8 AND confidence > 0.7""")
def stream_alert_table(spark: SparkSession, sf: str) -> DataFrame:
    """The alert table that the stream has written, of records that carry a time."""
    d = drained(spark, sf)
    timed = d.table("scored").where("has_time").select(ID)
    return d.table("alerts").join(timed, ID, "left_semi").select("alert_id", ID, "batch_id", "fraud_probability")


@query("stream_statistics", sql=SQL_ROUTES + """
SELECT count(*) AS total_transactions, count(*) FILTER (route = 'scored') AS n_scored, count(*) FILTER (route = 'duplicate') AS n_duplicate,
  count(*) FILTER (route = 'late') AS n_late, count(*) FILTER (route = 'error') AS n_error, count(DISTINCT round) AS batches,
  0 AS files_waiting, true AS has_processing_time FROM routes""")
def stream_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Live statistics from the stream's own progress table."""
    d = drained(spark, sf)
    routes = d.table("progress").agg(*[F.sum(f"n_{r}").alias(f"n_{r}") for r in det.ROUTES])
    live = d.running_statistics().select("total_transactions", "batches", "files_waiting", (F.col("avg_processing_time") > 0).alias("has_processing_time"))
    return live.join(F.broadcast(routes))            # one row each


@query("stream_history", sql=SQL_JUDGED + """
SELECT transaction_id, round(amount, 4) AS amount, merchant_category, location, p >= 0.6 AS is_fraud, p AS fraud_probability, round(confidence, 6) AS confidence_score,
  CASE WHEN p >= 0.9 THEN 'critical' WHEN p >= 0.8 THEN 'high' WHEN p >= 0.6 THEN 'medium' ELSE 'low' END AS risk_level,
  strftime(event_time, '%Y-%m-%d %H:%M:%S') AS timestamp, true AS timed FROM judgement""")
def stream_history(spark: SparkSession, sf: str) -> DataFrame:
    """All ten history columns of the records that carry a time; of the processing time, that it is there."""
    d = drained(spark, sf)
    timed = d.table("scored").where("has_time").select(ID)
    view = dashboard.history_view(d.history().join(timed, ID, "left_semi"))
    return view.select(*[c for c in view.columns if c not in ("row_color", "processing_time", "amount")],
                       F.round("amount", 4).alias("amount"), (F.col("processing_time") > 0).alias("timed"))


@query("stream_metrics", sql=SQL_JUDGED + """
SELECT count(*) AS total, count(*) FILTER (p >= 0.6) AS fraud_count, round(count(*) FILTER (p >= 0.6) * 100.0 / count(*), 6) AS fraud_rate_pct,
  count(*) FILTER (p >= 0.8) AS high_risk, round(avg(p), 6) AS avg_p, true AS timed FROM judgement""")
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The dashboard's metrics over the stream's history, the mean processing time among them (that it is there)."""
    d = drained(spark, sf)
    timed = d.table("scored").where("has_time").select(ID)
    m = dashboard.metrics(d.history().join(timed, ID, "left_semi"))
    return m.select(*[c for c in m.columns if c != "avg_processing_time"], (F.col("avg_processing_time") > 0).alias("timed"))
