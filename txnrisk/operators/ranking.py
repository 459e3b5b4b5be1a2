"""Places of rows in an order, within groups, without a window over a group.

Rows are dealt by range of (group, order) and sorted in their partitions; a
row's place is its place in the partition plus the counts of the partitions
before it.  The only window runs over those counts (partitions x groups rows),
so a group may hold all rows: the largest task holds a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.operators.joins import sized
from txnrisk.session import cut_lineage


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], place: str = "place", total: str = "total") -> DataFrame:
    """``df`` with ``place`` (from 0, ascending, NULLs first) and ``total`` of each
    group.  ``order`` should tell rows apart: ties get places in no fixed order."""
    keys, cols = [*group], df.columns
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_m"), F.min("_at").alias("_first"))
    mine = Window.partitionBy(*keys)
    before = F.sum("_m").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    side = sized(counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                               (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_move"), F.sum("_m").over(mine).alias("_total")))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(side, on).select(*cols, (F.col("_at") + F.col("_move")).alias(place), F.col("_total").alias(total))
