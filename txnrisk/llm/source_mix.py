"""Mixing sources to target weights by entropy balancing.

Rates ``w`` of documents stay as near to base rates ``q`` as one token constraint
per source, ``sum size * w = target``, and ``w <= max_rate`` allow: they minimise
the relative entropy, counted per document (``sum w log(w/q) - w + q``) or per token
(each term times the document's size).  The dual has one variable per source; its
solution tilts the base rates exponentially, ``w = min(max_rate, q * exp(lambda * z))``,
with ``z`` the document's size as a multiple of its source's mean (per document: few
documents change much, long ones before short ones) or 1 (per token: all of a source
and base rate alike).  Newton steps on all variables at once are DataFrame aggregates
over (source, base rate, z) cells, to which documents are summed once.  Rates are then
rounded into whole copies.

Rounding: inside each (source, size class, hash bucket) cell documents are laid
out by hash and copies are taken at whole steps of the running rate, so a cell's
copies differ from its rates by less than one document; then, a few times, the one document
of each source whose size comes nearest to what is left gets a copy more or
less.

Defined cases: a null text has size 0 and takes nothing; a null source is a
source of its own, after all others; repeated ids are documents of their own;
a source without words has target 0; texts are counted whole; a dual that
``MAX_STEPS`` steps don't settle is an error; empty tables give no rows; other columns
are ignored.  Order and partitioning of the input don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.operators.joins import sized
from txnrisk.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
TOLERANCE = 1e-9
MAX_STEPS = 60
ROUNDING_BUCKET_ROWS = 2_000
FIXES = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_ranks(sources: DataFrame, key: str) -> DataFrame:
    """``sources`` with ``rank`` (from 0) in code-point order of ``key``, null
    last, without one task that sorts all of them: range partitions are
    counted, and the counts summed before each partition are added."""
    key_order = [F.col(key).isNull().cast("int"), F.col(key)]
    parts = cut_lineage(sources.repartitionByRange(*key_order).withColumn(
        "_part", F.spark_partition_id()), "mix-ranges")
    starts = parts.groupBy("_part").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition at most
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*key_order)) - 1
    return (parts.withColumn("_local", local).join(F.broadcast(starts.select("_part", "_before")), "_part")
            .withColumn("rank", F.col("_before") + F.col("_local"))
            .drop("_part", "_local", "_before"))


def share_targets(sources: DataFrame, weights: tuple[float, ...], total_share: float,
                  cap: float) -> DataFrame:
    """``sources(source, source_size)`` with ``target``: ``total_share`` of all
    sizes is shared by weight (``weights`` repeat in source order); a target
    stops at ``cap`` times its source's size and what is above is shared
    anew by weight.  One two-number aggregate per round."""
    ranked = source_ranks(sources, "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("weight", w).drop("rank"), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level, done = total_share * total, 0.0, -1
    while True:
        full = F.col("weight") * level > cap * F.col("source_size")
        n, capped, free = ranked.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap * F.col("source_size"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == done or not free:
            break
        done, level = n, (budget - capped) / free
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level),
                                               cap * F.col("source_size"))).drop("weight")


def solve_dual(cells: DataFrame, targets: DataFrame, max_rate: float) -> DataFrame:
    """``(source, lam)``: the dual solution.  ``cells(source, q, z, size)``: all words of the
    documents with that base rate and exponent; ``targets(source, target)``.

    Newton on all sources at once, each within a bracket: a step that leaves it is
    replaced by its middle.  A source whose target asks for ``max_rate`` everywhere
    has no finite solution and gets +infinity, one with target 0 minus infinity."""
    # null-safe joins by a renamed key: a null source is a source too
    cells = cells.filter("size > 0").withColumnRenamed("source", "_s")
    on = F.col("source").eqNullSafe(F.col("_s"))
    tot = cells.groupBy("_s").agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("q")).alias("base"),
                                  F.min("q").alias("least_q"), F.min("z").alias("least_z"))
    limit = F.when(F.col("target") <= 0, F.lit(-math.inf)).when(
        F.col("target") >= max_rate * F.col("all"), F.lit(math.inf))
    first = F.log(F.try_divide("target", "base"))
    # below lo no rate is higher than the target's share, at hi all are capped
    lo = F.least(first, F.lit(0.0)) / F.col("least_z")
    hi = F.greatest(F.log(F.lit(max_rate) / F.col("least_q")), F.lit(0.0)) / F.col("least_z")
    lam = cut_lineage(targets.select("source", "target").join(tot, on).select(
        "source", "target", lo.alias("lo"), hi.alias("hi"), F.coalesce(limit, first).alias("lam")), "mix-dual")
    for _ in range(MAX_STEPS):
        raw = F.col("q") * F.exp(F.col("lam") * F.col("z"))
        step = cells.join(lam, on).groupBy("source", "target", "lam", "lo", "hi").agg(
            F.sum(F.col("size") * F.least(F.lit(max_rate), raw)).alias("got"),
            F.sum(F.when(raw < max_rate, F.col("size") * F.col("z") * raw)).alias("slope"))
        gap = F.col("target") - F.col("got")
        settled = F.col("lam").isin(math.inf, -math.inf) | (F.abs(gap) <= TOLERANCE * F.col("target"))
        step = step.withColumn("settled", settled).withColumn(
            "lo", F.when(gap > 0, F.col("lam")).otherwise(F.col("lo"))).withColumn(
            "hi", F.when(gap < 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + F.try_divide(gap, F.col("slope"))
        lam = cut_lineage(step.select(
            "source", "target", "lo", "hi", "settled",
            F.when(F.col("settled"), F.col("lam"))
            .when((newton > F.col("lo")) & (newton < F.col("hi")), newton)
            .otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam")), "mix-dual")
        if lam.filter(~F.col("settled")).isEmpty():
            return lam.select("source", F.round("lam", 12).alias("lam"))  # sums' last bits depend on their order
    raise RuntimeError(f"{lam.filter(~F.col('settled')).count()} sources are not settled after {MAX_STEPS} steps")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5,
        max_rate: float = 2.0, doc: str = "doc_id", text: str = "text", source: str = "source",
        base_rate: str | None = None, per: str = "token") -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies, taken)`` for
    every document; ``taken = copies * size`` with at most ``max_rate`` copies.
    ``base_rate`` names a column of positive prior rates (1 where absent or
    null); ``per``: what entropy is counted by, ``"token"`` or ``"document"``."""
    if per not in ("token", "document"):
        raise ValueError(f"per must be token or document, not {per}")
    q = F.coalesce(F.col(base_rate).cast("double"), F.lit(1.0)) if base_rate else F.lit(1.0)
    rows = cut_lineage(docs.select(F.col(doc).alias("doc_id"), F.col(source).cast("string").alias("source"),
                                   word_count(F.col(text)).alias("size"), q.alias("q")), "mix-sizes")
    by_size = F.col("size") if per == "document" else F.lit(1).cast("long")
    cells = cut_lineage(rows.groupBy("source", "q", by_size.alias("z")).agg(F.sum("size").alias("size"), F.count("*").alias("n")),
                        "mix-cells")
    targets = cut_lineage(share_targets(
        cells.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"),
                                    F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("n_words")),
        weights, total_share, max_rate), "mix-targets")
    unit = F.col("source_size") / F.col("n_words") if per == "document" else F.lit(1.0)
    units = targets.select(F.col("source").alias("_u"), unit.alias("unit"))
    scaled = cells.join(sized(units), F.col("source").eqNullSafe(F.col("_u"))).select(
        "source", "q", (F.col("z") / F.col("unit")).alias("z"), "size")
    lam = solve_dual(cut_lineage(scaled, "mix-scaled"), targets, max_rate)
    t = targets.withColumn("unit", unit).drop("n_words").withColumnRenamed("source", "_s").withColumnRenamed("n", "s_n").join(
        lam, F.col("source").eqNullSafe(F.col("_s")), "left").drop("source")
    rated = rows.join(sized(t, materialize=True), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    z = F.col("size") / F.col("unit") if per == "document" else F.lit(1.0)
    tilt = F.when(F.col("size") > 0, F.exp(F.col("lam") * z)).otherwise(1.0)
    rated = rated.withColumn("rate", F.least(F.lit(float(max_rate)), F.col("q") * tilt))
    return round_rates(rated.drop("lam", "q", "unit"), max_rate)


def round_rates(rated: DataFrame, max_rate: float) -> DataFrame:
    """Whole copies of about ``rate`` (see the module's text).  Cells hold
    about ``ROUNDING_BUCKET_ROWS`` rows at most: a source is cut by size class
    (powers of two) and by as many hash buckets as its row count asks for."""
    h = F.xxhash64("doc_id", "size", "source")
    rows = rated.withColumn("_h", h).withColumn("_class", F.floor(F.log2(F.col("size") + 1.0)).cast("int"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_h"), F.ceil(
        F.col("s_n") / ROUNDING_BUCKET_ROWS).cast("long")))
    cell = Window.partitionBy("source", "_class", "_bucket").orderBy("_h", "doc_id").rowsBetween(
        Window.unboundedPreceding, 0)
    # start inside the first step by a share that the cell's name fixes
    shift = F.pmod(F.xxhash64("source", "_class", "_bucket"), F.lit(1_000_003)) / 1_000_003.0
    # twice-used sum: rounded, so that the two floors see one number
    upto = F.round(F.sum("rate").over(cell) + shift, 9)
    before = F.round(F.sum("rate").over(cell) - F.col("rate") + shift, 9)
    most = int(max_rate)
    rows = rows.withColumn("copies", F.least(F.lit(most), F.greatest(
        F.lit(0), F.floor(upto) - F.floor(before))).cast("int")).drop("_class", "_bucket", "s_n")
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-copies")
    for _ in range(FIXES):
        left = rows.groupBy(F.col("source").alias("_s")).agg(
            (F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("_left"))
        off = F.abs(F.abs("_left") - F.col("size"))
        near = rows.select("source", "size", "_h", "_row", "copies").join(
            sized(left), F.col("source").eqNullSafe(F.col("_s"))).filter(
            (F.col("size") > 0) & (off < F.abs("_left"))
            & F.when(F.col("_left") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0))
        pick = cut_lineage(near.groupBy("_s").agg(F.min(F.struct(
            off.alias("off"), F.col("_h").alias("h"), F.col("_row").alias("row"),
            F.signum("_left").cast("int").alias("by"))).alias("p")), "mix-fix")
        if pick.isEmpty():
            break
        rows = cut_lineage(rows.join(sized(pick), F.col("source").eqNullSafe(F.col("_s")), "left").withColumn(
            "copies", F.col("copies") + F.when(F.col("_row") == F.col("p.row"), F.col("p.by")).otherwise(0)
        ).drop("_s", "p"), "mix-copies")
    return rows.select("doc_id", "source", "size", "source_size", "target", "rate", "copies",
                       (F.col("copies") * F.col("size")).alias("taken"))
