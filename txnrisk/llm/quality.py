"""Quality classifier: naive Bayes support vectors (NBSVM).

Features are indicators of n-grams: of words, and of word shapes (case, digits,
closing marks, length, same as the word before) up to three in a row; a shape
n-gram also says how large a share of its text it makes up, in powers of two.
An indicator is scaled by the log ratio of its smoothed counts in the two
classes, taken over all labelled rows, and the vector by its length; a linear
model with hinge loss is fitted to these vectors by dual coordinate descent,
and a sigmoid turns its margin into a probability.

Counts are summed by Spark (``BUCKETS`` numbers reach the driver).  The linear
model is fitted on a sample of about ``MAX_TRAIN`` labelled rows at most (by
hash of id and text), in ``SHARDS`` shards side by side whose weights are
averaged; another shard of that sample fits the sigmoid.  Every text is worked
through whole.

Defined cases: a null text is empty, and an empty text has one feature of its
own, so it is scored like any other; labels that are null are not learned from;
if only one class or nothing is labelled, all scores are that class's smoothed
share; repeated documents are scored each for itself, repeated labels count
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm import tokens
from txnrisk.llm.columns import small_batches
from txnrisk.llm.tokens import column_bytes, row_blocks
from txnrisk.operators.joins import sized
from txnrisk.session import cut_lineage

BITS = 18
BUCKETS = 1 << BITS
MAX_TRAIN = 40_000
SHARDS = 8
C, EPOCHS = 0.5, 15
THRESHOLD = 0.3

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_MARK = ~(_UPPER | _LOWER | _DIGIT)


def word_shapes(buf: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray,
                first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per word: its shape, and a class of its length.  ``first``: whether the word opens a row."""
    upper, lower = _UPPER[buf], _LOWER[buf]
    c3 = np.flatnonzero(buf[:-1] == 0xC3)  # capitals of Latin-1 in UTF-8
    cap = c3[(buf[c3 + 1] >= 0x80) & (buf[c3 + 1] <= 0x9E)]
    upper[cap], lower[cap], lower[cap + 1] = True, False, False

    def many(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=sums[1:])
        return sums[e] - sums[s]

    n_up, n_low, n_digit, size = many(upper), many(lower), many(_DIGIT[buf]), e - s
    case = np.where(n_up == 0, 0, np.where((n_up == 1) & upper[s], 1, np.where(n_low == 0, 2, 3)))
    end = np.where(_MARK[buf[e - 1]], buf[e - 1], 0)
    before = buf[np.maximum(e - 2, 0)]
    before = np.where((size > 1) & (end > 0) & _MARK[before], before, 0)
    same = np.append(False, h[1:] == h[:-1])[:len(h)] & ~first
    shape = end.astype(np.uint64) | before.astype(np.uint64) << np.uint64(8)
    for bit, x in ((16, case), (18, n_digit > 0), (19, same), (20, n_up + n_low + n_digit == 0)):
        shape |= x.astype(np.uint64) << np.uint64(bit)
    return shape, np.digitize(size, [2, 4, 7, 11, 16, 25]).astype(np.uint64)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their features (distinct), by row, for the texts at ``off``
    (from 0).  A row without words has feature 0."""
    n_rows = len(off) - 1
    h, s, e = tokens.words(buf, off[:-1])
    start = np.searchsorted(s, off)
    row = np.repeat(np.arange(n_rows), np.diff(start))
    n_words = np.diff(start)
    out = [np.flatnonzero(n_words == 0) << BITS]
    if len(h):
        first = np.zeros(len(h), bool)
        first[start[:-1][n_words > 0]] = True
        shape, size = word_shapes(buf, h, s, e, first)
        plain = (h >> np.uint64(64 - BITS)).astype(np.int64) | row << BITS
        out.append(np.unique(plain))
        for k, x in ((1, shape), (2, shape), (3, shape), (1, shape | size << np.uint64(24))):
            g = tokens.grams(x + np.uint64(k * 1_000_003 + (0 if x is shape else 17)), k)
            at = np.flatnonzero(np.arange(len(g)) + k <= start[1:][row[:len(g)]])
            g, r = g[at], row[at]
            # 40 bits of the n-gram are enough to tell those of one block apart
            key, n = np.unique(r << 40 | (g >> np.uint64(24)).astype(np.int64), return_counts=True)
            r, g = key >> 40, (key & ((1 << 40) - 1)).astype(np.uint64)
            share = np.minimum(7, np.floor(np.log2(np.maximum(n_words[r] - k + 1, 1) / n))).astype(np.uint64)
            for x2 in (g, g * np.uint64(8) + share + np.uint64(1 << 50)):
                out.append((tokens.mix(x2 * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64) | r << BITS)
    keys = np.unique(np.concatenate(out))
    return keys >> BITS, keys & (BUCKETS - 1)


def _blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = column_bytes(col)
    for a, z in row_blocks(off):
        row, f = features(buf[off[a]:off[z]], off[a:z + 1] - off[a])
        yield a, z, np.searchsorted(row, np.arange(z - a + 1)), f


def labelled_features(rows: DataFrame) -> DataFrame:
    """``(y, part, f)`` from ``rows(t, y, part)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, at, f in _blocks(b.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(a, z - a), b.column(2).slice(a, z - a),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f.astype(np.int32)))], ["y", "part", "f"])

    return small_batches(rows).mapInArrow(run, "y int, part double, f array<int>")


def _lists(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    return off - off[0], col.flatten().to_numpy()


def count_classes(train: DataFrame) -> DataFrame:
    """``(f, n0, n1)``: rows of either class that have feature f."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            off, f = _lists(b.column(1))
            y = np.repeat(b.column(0).to_numpy(), np.diff(off))
            for c in (0, 1):
                n[c] += np.bincount(f[y == c], minlength=BUCKETS)
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], ["f", "n0", "n1"])

    return train.select("y", "f").mapInArrow(run, "f long, n0 long, n1 long").groupBy("f").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def descend(off: np.ndarray, f: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Weights (the last is the intercept) by dual coordinate descent on the
    hinge loss: each step sets one row's dual variable to its best value."""
    w, sign = np.zeros(BUCKETS + 1), np.where(y > 0, 1.0, -1.0)
    xs = []
    for a, z in zip(off[:-1], off[1:]):
        i = np.append(f[a:z], BUCKETS)
        v = np.append(ratio[f[a:z]], 1.0)
        v[:-1] /= np.sqrt((v[:-1] ** 2).sum() + 1)
        xs.append((i, v, (v ** 2).sum()))
    dual = np.zeros(len(y))
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        moved = 0.0
        for r in rng.permutation(len(y)):
            i, v, q = xs[r]
            new = min(max(dual[r] - (sign[r] * (w[i] @ v) - 1) / q, 0.0), C)
            step = new - dual[r]
            if step:
                w[i] += step * sign[r] * v
                dual[r] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def margins(at: np.ndarray, f: np.ndarray, w: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    def sums(x: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(x))
        return total[at[1:]] - total[at[:-1]]

    r = ratio[f]
    return sums(w[f] * r) / np.sqrt(sums(r * r) + 1) + w[BUCKETS]


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid, by damped Newton steps on smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    loss = lambda a, b: (np.logaddexp(0, a * m + b) - t * (a * m + b)).sum()
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * m + b)))
        g = np.array([((p - t) * m).sum(), (p - t).sum()])
        q = p * (1 - p)
        hess = np.array([[(q * m * m).sum(), (q * m).sum()], [(q * m).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, g)
        size = 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > loss(a, b):
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(train: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, float, float]:
    """``(weights, ratios, slope, offset)`` from the table ``train(y, part, f)``;
    ``part`` is a row's place in [0, 1) by hash."""
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return np.zeros(BUCKETS + 1), np.zeros(BUCKETS), 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    seen = count_classes(train).toPandas()  # BUCKETS rows at most
    ratio = np.full(BUCKETS, np.log((1 / (n1 + 2)) / (1 / (n0 + 2))))
    ratio[seen["f"]] = np.log(((seen["n1"] + 1) / (n1 + 2)) / ((seen["n0"] + 1) / (n0 + 2)))
    shared = train.sparkSession.sparkContext.broadcast(ratio)
    share = min(1.0, max_train / (n0 + n1))
    shards = max(1, min(SHARDS, int((n0 + n1) * share) // 200))
    sample = train.filter(F.col("part") < share).select(
        F.floor(F.col("part") / share * (shards + 1)).cast("int").alias("shard"), "y", "f")

    def shard_fit(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        off, f = _lists(t.column("f").chunk(0))
        y = t.column("y").to_numpy()
        w = descend(off, f, y, shared.value)
        at = np.flatnonzero(w)
        return pa.table({"i": pa.array(at), "w": pa.array(w[at])})

    models = sample.filter(F.col("shard") < shards).groupBy("shard").applyInArrow(shard_fit, "i long, w double")
    mean = models.groupBy("i").agg((F.sum("w") / shards).alias("w")).toPandas()  # BUCKETS + 1 rows at most
    w = np.zeros(BUCKETS + 1)
    w[mean["i"]] = mean["w"]
    both = train.sparkSession.sparkContext.broadcast((w, ratio))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, f = _lists(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(margins(off, f, *both.value)), b.column(0)], ["m", "y"])

    # one shard of the sample: at most about max_train / shards pairs of numbers
    rest = sample.filter(F.col("shard") == shards).select("y", "f").mapInArrow(judge, "m double, y int").toPandas()
    return (w, ratio, *sigmoid_fit(rest["m"].to_numpy(), rest["y"].to_numpy()))


def score(rows: DataFrame, model: tuple, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` from ``rows(doc_id, held_out, t)``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, ratio, slope, offset = shared.value
        for b in batches:
            for a, z, at, f in _blocks(b.column(2)):
                p = 1 / (1 + np.exp(-np.clip(slope * margins(at, f, w, ratio) + offset, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(p),
                     pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return small_batches(rows).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, doc: str = "doc_id", text: str = "text",
          label: str = "quality", max_train: int = MAX_TRAIN) -> tuple:
    """A model from the labelled rows of ``docs`` that are not held out."""
    y = labels.filter(F.col(label).isNotNull()).select(F.col(doc).cast("long").alias("_id"), F.col(label).cast("int").alias("y"))
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")
    part = F.pmod(F.xxhash64(F.col(doc), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.filter(~held_out).select(F.col(doc).cast("long").alias("_id"), t.alias("t"), part.alias("part")).join(
        sized(y), "_id").select("t", "y", "part")
    return fit(cut_lineage(labelled_features(rows), "nbsvm-rows"), max_train)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, doc: str = "doc_id", text: str = "text",
             label: str = "quality", threshold: float = THRESHOLD, learn_from: DataFrame | None = None) -> DataFrame:
    """Score all ``docs`` with a model learned from ``learn_from`` (by default
    ``docs`` too)."""
    model = learn(docs if learn_from is None else learn_from, labels, held_out, doc, text, label)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), held_out.alias("held_out"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return score(rows, model, threshold)
