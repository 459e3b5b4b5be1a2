"""Hard negatives by Fagin's threshold algorithm.

For an anchor, its positives are the best rows of its label, and a positive's
negatives are the best rows of other labels whose score lies in a window below
the positive's.  Scores are inner products of whole numbers.

Candidates lie in shards; a shard holds its rows and, for each dimension, their
order by that component.  An anchor reads the lists of its non-zero components
side by side (sorted access), from the greatest values down where its own
component is positive and from the smallest up where it is negative.  Each row
that turns up for the first time gets its whole score at once (random access).
No row not yet seen can score more than the threshold, the sum over the lists of
the anchor's component times the value last read.  A window is done once the
threshold is strictly below its k-th score (an equal score could still win by
its id), or below the window itself; the anchor is done with the shard when all its
windows are.  Lists are read in steps that double, each step in one go.

Spark's part: shards follow the number of rows, by a hash of whole rows, so that no
label, id or repeated vector makes one larger; anchors come in blocks of ``ANCHOR_BLOCK``,
one after another, and each is sent to all shards.  Per block one job finds the
positives (a few rows an anchor, which set the windows) and one the negatives; the
shards' best are ranked per window.

Arithmetic is exact: doubles while all sums stay below 2^53, longs below 2^63, Python's
whole numbers beyond.

Defined cases: rows with a null id, label or vector, or with a component that is
null, NaN or infinite, take no part; components whose ``scale``-fold doesn't fit a
long count as the nearest long, scores beyond a long are returned as the nearest
one (and beyond 38 digits ranked as such); equal rows count once; rows that share an id but differ are rows of
their own, but none is a candidate of an anchor with its id; only vectors of
the anchor's length are its candidates; empty vectors score 0; anchors without positives
and positives whose window holds nothing give no rows; an empty table gives
none; other columns are ignored.  There is no text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.session import cut_lineage

POSITIVES, NEGATIVES = 5, 10
LOWER, UPPER = 30, 90
"""A negative's score lies between these percentages of the positive's."""
SCALE = 256
SHARD_ROWS = 4096
#: components of a shard, at 12 bytes each
SHARD_COMPONENTS = 1 << 19
ANCHOR_BLOCK = 4096
#: files of a table of lists
MAX_FILES = 20_000
#: entries of each list read in the first step
STEP = 16
LISTS = "dim int, shard long, ids binary, labels binary, vectors binary, orders binary, n int"
FOUND = "anchor int, positive int, id long, score decimal(38,0)"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
_LONG, _MOST = 2 ** 63, 10 ** 38 - 1


def taking_part(rows: DataFrame, scale: int = SCALE, vec: str = "vec_id", embedding: str = "embedding", label: Column | None = None) -> DataFrame:
    """``(id, label, v)``: distinct rows that take part, components as whole numbers."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    label = F.col("label") if label is None else label
    kept = rows.filter(F.col(vec).isNotNull() & label.isNotNull() & F.col(embedding).isNotNull() & ~bad)
    return kept.select(F.col(vec).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(
        embedding, lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()


# --- lists --------------------------------------------------------------------------

def _lists(t: pa.Table) -> pa.Table:
    """Rows of one shard and their order by each component."""
    t = t.combine_chunks()
    n, dim = t.num_rows, t.column("dim")[0].as_py()
    x = np.array(t.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False), np.int64).reshape(n, dim)
    orders = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)
    number = lambda c: [np.ascontiguousarray(np.asarray(t.column(c).chunk(0)), np.int64).tobytes()]
    return pa.table({"dim": t.column("dim").slice(0, 1), "shard": t.column("shard").slice(0, 1), "ids": pa.array(number("id"), pa.binary()),
                     "labels": pa.array(number("label"), pa.binary()), "vectors": pa.array([x.tobytes()], pa.binary()),
                     "orders": pa.array([np.ascontiguousarray(orders).tobytes()], pa.binary()), "n": pa.array([n], pa.int32())})


def build(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Table of ``LISTS`` over ``rows(id, label, v)``, one row a shard and vector length."""
    n, components = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    shards = max(1, -(-n // shard_rows), -(-components // SHARD_COMPONENTS))
    dealt = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "label", "v"), F.lit(shards)).alias("shard"), "id", "label", "v")
    dealt = dealt.repartition(min(shards, MAX_FILES), "dim", "shard")  # a file is a task of the searches
    return cut_lineage(dealt.groupBy("dim", "shard").applyInArrow(_lists, LISTS), "fagin-lists")


# --- the threshold algorithm --------------------------------------------------------

class Lists:
    """One shard in memory."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["vectors"], np.int64).reshape(n, dim)
        self.orders = np.frombuffer(row["orders"], np.int32).reshape(dim, n)
        self.most = max(abs(int(self.x.min(initial=0))), int(self.x.max(initial=0)))
        self.forms: dict[type, np.ndarray] = {np.int64: self.x}

    def exact(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and ``a`` in the cheapest form in which no sum of their products loses a unit."""
        bound = self.most * sum(abs(int(c)) for c in a)
        kind = np.float64 if bound < 2 ** 53 else np.int64 if bound < _LONG else object
        if kind not in self.forms:
            self.forms[kind] = self.x.astype(kind)
        return self.forms[kind], a.astype(kind)


def threshold(lists: Lists, a: np.ndarray, candidate: np.ndarray, windows: list[tuple[float, float]], k: int,
              step: int = STEP) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window ``(least, greatest score)`` the rows of its best ``k`` candidates, in no
    order and with those that tie with the last, and their scores; and how many rows were read."""
    x, a = lists.exact(a)
    used = np.flatnonzero(a != 0)
    n = len(lists.ids)
    lists_of = np.where((a[used] > 0)[:, None], lists.orders[used][:, ::-1], lists.orders[used])  # best first
    seen, depth = np.zeros(n, bool), 0
    rows, scores = np.zeros(0, np.int64), np.zeros(0, a.dtype)
    best: list[tuple[np.ndarray, np.ndarray]] = [(rows, scores)] * len(windows)
    open_ = [w for w, (low, high) in enumerate(windows) if low <= high]
    while open_ and depth < n:
        until = min(n, depth + step) if len(used) else n
        got = np.zeros(n, bool)
        if len(used):
            got[lists_of[:, depth:until]] = True
            got &= ~seen
        else:  # all scores are 0
            got[:] = True
        seen |= got
        fresh = np.flatnonzero(got & candidate)
        scores = x[fresh] @ a
        least = sum(int(a[c]) * int(x[lists_of[i, until - 1], c]) for i, c in enumerate(used))
        still = []
        for w in open_:
            low, high = windows[w]
            inside = (scores >= low) & (scores <= high)
            r, s = np.append(best[w][0], fresh[inside]), np.append(best[w][1], scores[inside])
            if len(r) > k:
                kth = np.sort(s)[-k]
                r, s = r[s >= kth], s[s >= kth]
            best[w] = (r, s)
            if least >= low and (len(r) < k or least >= s.min()):
                still.append(w)
        open_, depth, step = still, until, 2 * step
    return best, int(seen.sum())


def _first(lists: Lists, rows: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """``(id, score)`` of the first ``k``, by falling score, then id."""
    order = sorted(zip((-int(s) for s in scores), lists.ids[rows].tolist()))[:k]
    return ((i, -s) for s, i in order)


def _search(shared, k: int):
    """Over shards: the best ``k`` of each window of all anchors; same label where ``windows`` is None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows = shared.value
        for b in batches:
            for row in b.to_pylist():
                lists, out = Lists(row), []
                for number, (own, label, v) in enumerate(anchors):
                    mine = [(-math.inf, math.inf)] if windows is None else [w[:2] for w in windows[number]]
                    if len(v) != row["dim"] or not mine:
                        continue
                    candidate = (lists.labels == label) == (windows is None)
                    candidate &= lists.ids != own
                    if not candidate.any():
                        continue
                    best, _ = threshold(lists, v, candidate, mine, k)
                    for w, (rows, scores) in enumerate(best):
                        out += [(number, w, i, Decimal(max(-_MOST, min(_MOST, s)))) for i, s in _first(lists, rows, scores, k)]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (
                    pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))], names=["anchor", "positive", "id", "score"])
    return run


def _best(lists: DataFrame, anchors: list, windows: list | None, k: int) -> DataFrame:
    """``(anchor, positive, rank, id, score)``: the shards' best, ranked."""
    shared = lists.sparkSession.sparkContext.broadcast((anchors, windows))
    found = cut_lineage(lists.mapInArrow(_search(shared, k), FOUND), "fagin-found")
    shared.unpersist()
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _window(score: int, lower: int, upper: int) -> tuple[int, int]:
    """Whole scores from ``lower`` to ``upper`` percent of ``score``."""
    return -(-lower * score // 100), upper * score // 100


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER,
         shard_rows: int = SHARD_ROWS, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """``RESULT`` for the ``rows(id, label, v)`` that ``is_anchor`` (a condition on ``id``)."""
    spark = rows.sparkSession
    rows = cut_lineage(rows, "fagin-rows")
    lists = build(rows, shard_rows)
    chosen = rows.filter(is_anchor)
    blocks = max(1, -(-chosen.count() // anchor_block))
    chosen = cut_lineage(chosen.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks))), "fagin-anchors")
    near = lambda s: max(-_LONG, min(_LONG - 1, s))
    result = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for block in range(blocks):
        t = chosen.filter(F.col("block") == block).select("id", "label", "v").toArrow()  # about a block's rows
        anchors = [(i, label, np.array(v, np.int64)) for i, label, v in zip(*(c.to_pylist() for c in t.columns))]
        windows: list[list] = [[] for _ in anchors]
        for r in _best(lists, anchors, None, positives).orderBy("anchor", "rank").collect():  # ``positives`` an anchor
            windows[r["anchor"]].append((*_window(int(r["score"]), lower, upper), r["id"], int(r["score"])))
        named = spark.createDataFrame(
            [(a, p, anchors[a][0], i, near(s)) for a, ws in enumerate(windows) for p, (_, _, i, s) in enumerate(ws)],
            "anchor int, positive int, anchor_id long, positive_id long, positive_score long")
        best = _best(lists, anchors, windows, negatives).join(F.broadcast(named), ["anchor", "positive"])  # a block's positives
        bound = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
        clipped = F.greatest(F.least("score", bound(_LONG - 1)), bound(-_LONG))
        result = result.union(best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                          clipped.cast("long").alias("negative_score")))
    return result
