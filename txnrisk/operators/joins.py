"""Joins of a large row table to a small-per-key table, with a checked size.

The per-key side (customer statistics, customer profiles, vocabularies)
grows with the number of keys, not the number of rows, but is not bounded by
construction.  So the side is first materialised (a small table in the shared
checkpoint folder), its row count is checked, and:

* at most ``BROADCAST_MAX_ROWS`` rows: broadcast hash join -- the large side
  is not shuffled at all;
* more: a shuffled sort-merge join; AQE splits skewed partitions of the large
  side (a hot customer) and replicates the matching side rows.

Leaving the choice to AQE alone would shuffle the large side before the
runtime switch to a broadcast join; checking first avoids that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.session import cut_lineage

BROADCAST_MAX_ROWS = 2_000_000
# compressed Parquet bytes of a materialised side (about 10x less than its
# in-memory hash relation)
BROADCAST_MAX_FILE_BYTES = 32 * 1024 * 1024


def is_small(side: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Row count within ``max_rows`` (the count stops at ``max_rows + 1``)."""
    return side.limit(max_rows + 1).count() <= max_rows


def file_bytes(df: DataFrame) -> int | None:
    """Size of the files that a scan-only DataFrame reads, from the statistics
    that the scan already holds (no job, one call), or None for other plans."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    return int(str(plan.stats().sizeInBytes()))


def broadcast_table(table: DataFrame, max_file_bytes: int = BROADCAST_MAX_FILE_BYTES) -> DataFrame:
    """A written table, with a broadcast hint iff its files are small."""
    nbytes = file_bytes(table)
    return F.broadcast(table) if nbytes is not None and nbytes <= max_file_bytes else table


def sized(side: DataFrame, materialize: bool = True, max_rows: int = BROADCAST_MAX_ROWS,
          max_file_bytes: int = BROADCAST_MAX_FILE_BYTES) -> DataFrame:
    """The side, materialised if asked, with a broadcast hint iff it is
    small: a materialised side by its file size (metadata only), any other
    side by its row count (the count stops at ``max_rows + 1``)."""
    if materialize:
        return broadcast_table(cut_lineage(side, "join-side"), max_file_bytes)
    return F.broadcast(side) if is_small(side, max_rows) else side


def sized_join(rows: DataFrame, side: DataFrame, on: str | list[str] | Column,
               how: str = "left", materialize: bool = True,
               max_rows: int = BROADCAST_MAX_ROWS,
               max_file_bytes: int = BROADCAST_MAX_FILE_BYTES) -> DataFrame:
    return rows.join(sized(side, materialize, max_rows, max_file_bytes), on, how)
