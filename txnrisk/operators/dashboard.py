"""Dashboard queries over the scored history: projections, last-N, totals,
distributions and time series.  Totals are mergeable aggregates (counts and
sums), so they stay exact when computed per partition or per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions import policies as pol

ID = "transaction_id"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss"
HISTORY_COLUMNS = ["transaction_id", "amount", "merchant_category", "location", "is_fraud",
                   "fraud_probability", "risk_level", "confidence_score", "timestamp"]


def history(scored: DataFrame) -> DataFrame:
    """History record: result fields plus the transaction fields shown, and
    the processing time (seconds) where the scored rows carry one."""
    timed = ["processing_time"] if "processing_time" in scored.columns else []
    return scored.select(
        ID, "amount", "merchant_category", "location",
        F.col("is_fraud_pred").alias("is_fraud"), "fraud_probability", "risk_level",
        "confidence_score", *timed, F.col("event_time").alias("timestamp"))


def history_view(hist: DataFrame) -> DataFrame:
    """Display projection: formatted time and a row colour by level."""
    timed = ["processing_time"] if "processing_time" in hist.columns else []
    return hist.select(*[c for c in HISTORY_COLUMNS if c != "timestamp"], *timed,
                       F.date_format("timestamp", TS_FORMAT).alias("timestamp"),
                       pol.row_color("risk_level").alias("row_color"))


def filter_history(hist: DataFrame, levels=None, min_p: float | None = None,
                   start=None, end=None) -> DataFrame:
    out = hist
    if levels is not None:
        out = out.where(F.col("risk_level").isin(*levels))
    if min_p is not None:
        out = out.where(F.col("fraud_probability") >= min_p)
    if start is not None:
        out = out.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("timestamp") < F.lit(end))
    return out


def shuffled(df: DataFrame, id_col: str = ID) -> DataFrame:
    """A reproducible row shuffle, for outputs whose order is visible: order by
    a hash of the id (a range-partitioned sort).  Row order has no meaning in
    a Spark table, so nothing else needs this."""
    return df.orderBy(F.md5(F.col(id_col).cast("string")), id_col)


def last_n(df: DataFrame, n: int, ts: str = "event_time") -> DataFrame:
    """Newest ``n`` rows (ties broken by id): TakeOrderedAndProject, a
    per-partition top-n then one merge of at most n rows per partition."""
    return df.orderBy(F.col(ts).desc(), F.col(ID).desc()).limit(n)


def metrics(hist: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    fraud = F.count_if(F.col("is_fraud"))
    return hist.agg(
        total.alias("total"), fraud.alias("fraud_count"),
        F.round(F.when(total > 0, fraud * 100.0 / total).otherwise(0.0), 6).alias("fraud_rate_pct"),
        F.count_if(F.col("risk_level").isin(*pol.ALERT_LEVELS)).alias("high_risk"),
        F.round(F.avg("fraud_probability"), 6).alias("avg_p"),
        *([F.avg("processing_time").alias("avg_processing_time")] if "processing_time" in hist.columns else []))


def risk_distribution(hist: DataFrame) -> DataFrame:
    return hist.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


def risk_ranked(hist: DataFrame) -> DataFrame:
    """The distribution, most frequent level first (``place`` from 1)."""
    order = Window.orderBy(F.desc("n"), "risk_level")        # a row a level
    return risk_distribution(hist).withColumn("place", F.row_number().over(order)).orderBy("place")


def probability_series(hist: DataFrame, width: str = "1 day") -> DataFrame:
    """Fraud probability over time, one series per decision: windowed means
    (bounded output however many rows there are)."""
    return (hist.groupBy(F.window("timestamp", width).start.alias("day"),
                         F.col("is_fraud").alias("is_fraud_pred"))
            .agg(F.round(F.avg("fraud_probability"), 6).alias("avg_p"),
                 F.count(F.lit(1)).alias("n")))


def series_points(hist: DataFrame, width: str = "1 hour", ts: str = "timestamp", value: str = "fraud_probability",
                  series: str = "is_fraud") -> DataFrame:
    """The per-row series with as few points as draw the same line (M4, Jugel et al.,
    VLDB 2014): of each series and time bucket the first, last, least and greatest
    point, as they are.  One partial aggregation, at most four points a bucket;
    ties go to the smaller id."""
    t, v = F.col(ts), F.col(value)
    points = hist.where(t.isNotNull() & v.isNotNull()).groupBy(F.window(t, width).start.alias("bucket"), F.col(series)).agg(
        F.min(F.struct(t.alias("t"), F.col(ID).alias("i"), v.alias("v"))).alias("first"),
        F.max(F.struct(t.alias("t"), (-F.col(ID)).alias("i"), v.alias("v"))).alias("last"),
        F.min(F.struct(v.alias("v"), t.alias("t"), F.col(ID).alias("i"))).alias("least"),
        F.max(F.struct(v.alias("v"), (-F.unix_micros(F.expr(f"CAST({ts} AS TIMESTAMP)"))).alias("n"), (-F.col(ID)).alias("i"), t.alias("t"))).alias("most"))
    kept = F.array(*[F.struct(F.lit(k).alias("kind"), F.abs(F.col(f"{k}.i")).alias(ID), F.col(f"{k}.t").alias(ts), F.col(f"{k}.v").alias(value))
                     for k in ("first", "last", "least", "most")])
    # a point may be, say, first and least: it is drawn once
    return points.select("bucket", series, F.inline(kept)).groupBy("bucket", series, ID, ts, value).agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"))


def page(hist: DataFrame, column: str, n: int, after: tuple | None = None, descending: bool = False) -> DataFrame:
    """The next ``n`` rows by any column, NULLs last, ties by id.  ``after``: value
    and id of the last row shown.  The bound is a filter, so a page costs a
    top-n of what lies behind it, however far down it is (no offset is counted)."""
    c = F.col(column)
    rows = hist
    if after is not None:
        value, last = after
        if value is None:
            rows = hist.where(c.isNull() & (F.col(ID) > last))
        else:
            bound = F.lit(value)
            beyond = c < bound if descending else c > bound
            rows = hist.where(c.isNull() | beyond | ((c == bound) & (F.col(ID) > last)))
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return rows.orderBy(order, ID).limit(n)


def running_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("total_transactions"),
                      F.count_if(F.col("is_fraud_pred")).alias("fraud_detected"),
                      F.count_if(F.col("alert_triggered")).alias("alerts_triggered"))
