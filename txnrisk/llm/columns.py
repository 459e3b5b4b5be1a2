"""Column helpers shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.session import cut_lineage

CHUNK = 512


def prefix_sums(lengths: Column) -> Column:
    """Exclusive running sums of an array of longs: ``[0, a0, a0+a1, ...]``,
    one entry per element.  ``aggregate`` copies its array at each append, so
    the sums are taken inside chunks of ``CHUNK`` elements and then over the
    chunk totals; the cost stays near linear for long arrays."""
    zero = F.lit(0).cast("long")

    def running(arr: Column, start: Column) -> Column:
        # [start, start+a0, ...]: one entry more than arr
        return F.aggregate(arr, F.array(start),
                           lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    n = F.size(lengths)
    chunks = F.when(n > 0, F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")),
        lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(
            F.array().cast("array<array<bigint>>"))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
    return F.flatten(F.zip_with(
        chunks, F.slice(running(totals, zero), F.lit(1), F.size(chunks)),
        lambda c, s: F.slice(running(c, s), F.lit(1), F.size(c))))


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with added columns that are computed once per row.  A plain
    ``withColumn`` is inlined into every later expression that names it, which
    repeats costly ones (regular expressions over whole texts); a one-row
    generator keeps them apart."""
    return df.select("*", F.inline(F.array(F.struct(
        *[c.alias(n) for n, c in cols.items()]))))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, see ``cut_lineage``; the shuffle
    files of its job go when the job ends, not when the driver's memory is next
    cleaned, so that large steps don't pile up on disk."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return cut_lineage(df, name)
    finally:
        conf.set(key, before)


#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session has been told to hand texts to Python
    ``TEXT_ROWS`` at a time: executors hold a batch several times over on both
    sides of the pipe.  The setting stays, as frames are lazy."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXT_ROWS:
        conf.set(key, TEXT_ROWS)
    return df
