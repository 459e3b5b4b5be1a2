"""Per-key (per-customer) statistics without single-task hot keys.

A customer may own a third of all rows, so nothing here runs a window that is
partitioned by the customer alone over raw rows:

* whole-history statistics are a ``groupBy`` (partial aggregation on the map
  side, one row per key after the shuffle) joined back to the rows.  The join
  is a plain equi-join: Catalyst/AQE broadcast the statistics when their
  measured size is under the threshold, else a sort-merge join whose skewed
  partitions AQE splits (``spark.sql.adaptive.skewJoin``).
* ordered (as-of) statistics use a two-level prefix: rows are windowed inside
  ``(key, time bucket)`` partitions, and per-bucket totals (one row per key and
  bucket) are prefix-summed per key and joined back on ``(key, bucket)``.  A hot
  key is spread over its buckets.
* trailing-interval counts use bucket = interval width: every row also casts a
  "shadow" one interval later, so all rows inside ``[t - w, t]`` meet inside a
  single ``(key, bucket)`` partition.  Rows are first summed to distinct times,
  so a busy bucket holds its times, not its rows.  Exact, no pairs are emitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.operators.joins import sized, sized_join


MONEY = "decimal(28,8)"


def key_stats(df: DataFrame, key: str, value: str, n: str = "n", mean: str = "mean",
              std: str = "std") -> DataFrame:
    """count / mean / sample std of ``value`` per key (NULL std for one row).
    The mean is exact on money decimals (see ``features.money_avg``)."""
    return (df.groupBy(key)
            .agg(F.count(value).alias(n),
                 F.round(F.avg(F.col(value).cast(MONEY)), 8).cast("double").alias(mean),
                 F.stddev_samp(value).alias(std)))


def attach(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """Left equi-join of a one-row-per-key table onto rows.

    NULL keys get no match (as a pandas ``groupby`` drops NULL keys).  The
    per-key table grows with the number of customers: it is materialised and
    broadcast only under a checked row count, else sort-merge joined
    (``operators.joins``).
    """
    return sized_join(rows, per_key, key, "left")


def attach_key_stats(rows: DataFrame, key: str, value: str, n: str, mean: str,
                     std: str) -> DataFrame:
    return attach(rows, key_stats(rows, key, value, n, mean, std), key)


def _bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts))


def asof_stats(df: DataFrame, key: str, ts: str, tiebreak: str, value: str,
               unit: str = "hour", n: str = "n_before", mean: str = "avg_before",
               std: str = "std_before") -> DataFrame:
    """count / mean / sample std of ``value`` over the same key's rows strictly
    before each row in ``(ts, tiebreak)`` order.  Two-level prefix sums."""
    b = "_bkt"
    x = F.col(value).cast("double")
    xd = F.col(value).cast(MONEY)
    # rows without a key have no history: they are spread, not windowed in one group
    apart = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(tiebreak), F.lit(1 << 16))).otherwise(F.lit(-1))
    rows = df.withColumns({b: _bucket(ts, unit), "_apart": apart})
    local_w = (Window.partitionBy(key, b, "_apart").orderBy(ts, tiebreak)
               .rowsBetween(Window.unboundedPreceding, -1))
    # one select: the three frames share a spec and run in one Window operator
    rows = rows.select(
        "*", F.count(x).over(local_w).alias("_ln"),
        F.coalesce(F.sum(xd).over(local_w), F.lit(0).cast(MONEY)).alias("_ls"),
        F.coalesce(F.sum(x * x).over(local_w), F.lit(0.0)).alias("_lq"))
    totals = (df.withColumn(b, _bucket(ts, unit))
              .where(F.col(key).isNotNull())
              .groupBy(key, b)
              .agg(F.count(x).alias("_tn"), F.sum(xd).alias("_ts"), F.sum(x * x).alias("_tq")))
    # one row per (key, bucket): a hot key has at most #buckets rows here
    prev_w = (Window.partitionBy(key).orderBy(b)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        key, b,
        F.coalesce(F.sum("_tn").over(prev_w), F.lit(0)).alias("_on"),
        F.coalesce(F.sum("_ts").over(prev_w), F.lit(0).cast(MONEY)).alias("_os"),
        F.coalesce(F.sum("_tq").over(prev_w), F.lit(0.0)).alias("_oq"))
    # null-safe on the bucket: rows without a time are a bucket of their own
    offsets = offsets.withColumnRenamed(key, "_ok").withColumnRenamed(b, "_ob")
    out = rows.join(offsets, (F.col(key) == F.col("_ok")) & F.col(b).eqNullSafe(F.col("_ob")), "left").drop("_ok", "_ob")
    cnt = F.col("_ln") + F.col("_on")
    s = (F.col("_ls") + F.col("_os")).cast("decimal(32,8)")   # exact; the division keeps 14 places
    sd = s.cast("double")
    q = F.col("_lq") + F.col("_oq")
    var = F.greatest(F.lit(0.0), (q - sd * sd / cnt) / (cnt - 1))
    has_key = F.col(key).isNotNull()
    return (out
            .withColumn(n, F.when(has_key, cnt))
            .withColumn(mean, F.when(has_key & (cnt > 0), F.round(
                s / cnt.cast("decimal(14,0)"), 8).cast("double")))
            .withColumn(std, F.when(has_key & (cnt > 1), F.sqrt(var)))
            .drop(b, "_apart", "_ln", "_ls", "_lq", "_on", "_os", "_oq"))


_UNIT_INTERVAL = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR",
                  "day": "INTERVAL 1 DAY"}


def trailing_count(df: DataFrame, key: str, ts: str, out: str = "n_trailing",
                   unit: str = "hour") -> DataFrame:
    """Rows of the same key with time in ``[ts - 1 unit, ts]`` (peers included),
    i.e. ``count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN 1 unit
    PRECEDING AND CURRENT ROW)`` without a per-key partition.  Rows at or
    before t in t's bucket are counted directly, those of the bucket before
    through shadows at or after t: all shadows of the bucket less those before
    t.  Linear in the number of distinct times.  Rows without key or time get
    NULL and pass by the window."""
    interval = F.expr(_UNIT_INTERVAL[unit])
    per = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, F.col(ts).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"))
    real = per.select(key, "_t", F.col("_n").alias("_real"), F.lit(0).cast("long").alias("_shadow"))
    shadow = per.select(key, (F.col("_t") + interval).alias("_t"), F.lit(0).cast("long").alias("_real"), F.col("_n").alias("_shadow"))
    times = real.unionByName(shadow).groupBy(key, "_t").agg(F.sum("_real").alias("_real"), F.sum("_shadow").alias("_shadow")) \
                .withColumn("_b", F.date_trunc(unit, F.col("_t")))
    # one row per time from here on, so every frame grows by one row at a time
    bucket = Window.partitionBy(key, "_b")
    upto = bucket.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    le = F.sum("_real").over(upto)
    ge = F.sum("_shadow").over(bucket) - F.sum("_shadow").over(upto) + F.col("_shadow")
    counts = times.select(key, "_t", "_real", (le + ge).alias(out)).where("_real > 0") \
                  .select(F.col(key).alias("_ck"), F.col("_t").alias(ts), out)
    side = sized(counts)
    return df.join(side, (df[key] == side["_ck"]) & (df[ts] == side[ts]), "left").drop("_ck").drop(side[ts])
