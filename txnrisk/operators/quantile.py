"""Exact quantiles of distributed columns.

Values are counted (partial aggregation), the distinct ones dealt out by
range, and the counts of ranges summed up; the two order statistics around a
quantile then lie in known ranges, and only those are ordered.  No task holds
more than a range, at any size, and the result is numpy's linear interpolation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.session import cut_lineage


def quantiles(long: DataFrame, probs: Sequence[float], key: str = "feature", value: str = "x",
              ranges: int | None = None) -> DataFrame:
    """``(key, p, quantile)`` of ``long(key, value)``; NULL and NaN don't count,
    and a key without values has no row.  ``ranges``: number of value ranges
    (default: the session's shuffle partitions)."""
    x = F.col(value).cast("double")
    counted = (long.select(F.col(key).alias("_k"), x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
               .groupBy("_k", "_x").agg(F.count(F.lit(1)).alias("_n")))
    dealt = counted.repartitionByRange(ranges, "_k", "_x") if ranges else counted.repartitionByRange("_k", "_x")
    counts = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()), "quantile-counts")
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("_k", "_part").agg(F.sum("_n").alias("_m")).select(   # keys x ranges rows
        "_k", "_part", "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
        F.sum("_m").over(Window.partitionBy("_k")).alias("_total"))
    pos = F.col("p") * (F.col("_total") - 1)
    wanted = (parts.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
              .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))))
              .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_m")))
              .select("_k", "_part", "p", "_rank", "_before", pos.alias("_pos")))
    wanted = F.broadcast(cut_lineage(wanted, "quantile-ranks"))                  # two rows per key and p
    upto = Window.partitionBy("_k", "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    near = counts.join(wanted.select("_k", "_part").distinct(), ["_k", "_part"], "left_semi") \
                 .withColumn("_upto", F.sum("_n").over(upto))
    place = F.col("_rank") - F.col("_before")
    found = near.join(wanted, ["_k", "_part"]).where((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")))
    lo, hi = F.min(F.struct("_rank", "_x"))["_x"], F.max(F.struct("_rank", "_x"))["_x"]
    share = F.first("_pos") - F.floor(F.first("_pos"))
    return found.groupBy(F.col("_k").alias(key), "p").agg((lo + (hi - lo) * share).alias("quantile"))


def quantile(df: DataFrame, column: str, p: float) -> float | None:
    """One quantile of one column, as a number."""
    row = quantiles(df.select(F.lit(0).alias("feature"), F.col(column).alias("x")), [p]).first()
    return None if row is None else row["quantile"]
