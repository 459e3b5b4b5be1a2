"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one binary classifier per bit tells, from
n-grams, whether a text's language has that bit.  A text goes to the language
whose codeword loses least, each bit weighed by how well its classifier parts
the languages it was learned on (loss-weighted decoding); a text whose second
language is nearly as good is flagged as ambiguous.

A bit's classifier is naive Bayes over hashed byte n-grams of lower-case text:
the mean log ratio of an n-gram's rates in the languages with and without the
bit.  Rates come from all learning documents, summed by Spark per (language,
n-gram); the driver gets that table, of languages x ``buckets`` cells at most.
Texts are worked through whole, in blocks.

Codewords: for up to 5 languages all different splits of them, beyond that
seeded random words, each chosen from many to lie far from the others.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so
are all texts if nothing can be learned; with one known language every other
text is of that language; a null language is never learned from; repeated rows
count and are answered each for itself; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.columns import small_batches
from txnrisk.llm.tokens import column_bytes, row_blocks

BUCKETS = 1 << 14
SIZES = (2, 3)
BLOCK = 1 << 19
SMOOTHING = 0.5
AMBIGUOUS = 0.75
UNKNOWN = "und"


def _codes(buf: np.ndarray) -> np.ndarray:
    """Bytes with every blank, digit and ASCII mark as one and the same byte."""
    return _FOLD[buf]


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[x for x in range(128) if not chr(x).isalpha()]] = 32
_FOLD[65:91] += 32


def gram_ids(buf: np.ndarray, off: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: bucket of the n-gram at each byte, and which of
    them lie within one row (``off`` starts at 0)."""
    c = _codes(buf)
    end = np.repeat(off[1:], np.diff(off))
    for n in SIZES:
        if len(c) < n:
            continue
        x = np.zeros(len(c) - n + 1, np.uint32)
        for j in range(n):
            x = x * np.uint32(0x01000193) ^ c[j:len(c) - n + 1 + j] * np.uint32(0x9E3779B1)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield ((x >> np.uint32(13)) & np.uint32(buckets - 1)).astype(np.int64), np.arange(len(x)) + n <= end[:len(x)]


def count_grams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(lang, gram, n)`` summed over ``docs(t, lang)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            buf, off = column_bytes(b.column(0))
            for a, z in row_blocks(off, BLOCK):
                names = sorted(set(langs[a:z]))
                which = np.array([names.index(x) for x in langs[a:z]])
                row = np.repeat(which, np.diff(off[a:z + 1]))
                for g, ok in gram_ids(buf[off[a]:off[z]], off[a:z + 1] - off[a], buckets):
                    part = np.bincount((row[:len(g)] * buckets + g)[ok], minlength=len(names) * buckets)
                    for x, n in zip(names, part.reshape(len(names), buckets)):
                        seen[x] = seen.get(x, 0) + n
        for x, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "gram", "n"])

    return small_batches(docs).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def codewords(k: int, seed: int = 3) -> np.ndarray:
    """``k`` codewords of +1 and -1."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        splits = np.arange(1, 1 << (k - 1))
        bits = (splits[:, None] >> np.arange(k - 1)) & 1
        return np.where(np.hstack([np.zeros((len(splits), 1), int), bits]), -1.0, 1.0).T
    rng, length = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(k)))
    words = [rng.choice([-1.0, 1.0], length)]
    while len(words) < k:
        tries = rng.choice([-1.0, 1.0], (64, length))
        far = (tries[:, None, :] != np.array(words)).sum(2).min(1)
        words.append(tries[far.argmax()])
    out = np.array(words)
    return out[:, np.abs(out.sum(0)) < k]  # a bit that all languages share says nothing


@dataclass(frozen=True)
class Model:
    """``weights``: per bucket and bit, the log ratio over the bit's usual
    margin; ``bits``: a bit's weight in decoding."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bits: np.ndarray


def fit(counts: DataFrame, buckets: int = BUCKETS) -> Model:
    rows = counts.toPandas()  # languages x buckets
    langs = sorted(rows["lang"].unique())
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((buckets, 0), np.float32), np.zeros(0))
    rate = np.full((len(langs), buckets), SMOOTHING)
    np.add.at(rate, (rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), rows["gram"].to_numpy()),
              rows["n"].to_numpy())
    rate /= rate.sum(1, keepdims=True)
    code = codewords(len(langs))
    if len(langs) == 1:
        return Model(langs, code, np.zeros((buckets, 1), np.float32), np.ones(1))
    ratio = np.stack([np.log(rate[c > 0].mean(0) / rate[c < 0].mean(0)) for c in code.T], 1)
    margin = (rate @ ratio) * code  # what a text of each language gets on average, along its bit
    scale = np.abs(margin).mean(0)
    parts = np.clip(margin.min(0) / scale, 0.05, 1.0)
    return Model(langs, code, (ratio / scale).astype(np.float32), parts / parts.sum() * len(parts))


def decode(m: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language (index), its share of exp(-loss), and second-best share."""
    loss = (np.logaddexp(0, -2.0 * margins[:, None, :] * m.code[None]) * m.bits).sum(2)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    share /= share.sum(1, keepdims=True)
    order = np.argsort(-share, axis=1, kind="stable")
    rows = np.arange(len(share))
    second = share[rows, order[:, 1]] if share.shape[1] > 1 else np.zeros(len(share))
    return order[:, 0], share[rows, order[:, 0]], second


def predict(docs: DataFrame, model: Model, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``docs(doc_id, t, letters, held_out)`` to ``(doc_id, held_out,
    lang_pred, score, ambiguous)``."""
    # plain values: what is broadcast is unpickled without this package
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.code, model.weights, model.bits))
    buckets = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            buf, off = column_bytes(b.column(1))
            n_bits = m.weights.shape[1]
            total, n = np.zeros((b.num_rows, n_bits)), np.zeros(b.num_rows)
            for a, z in row_blocks(off, BLOCK):
                for lo in range(off[a], off[z], 4 * BLOCK):  # a long row in pieces that overlap by an n-gram
                    hi = min(off[z], lo + 4 * BLOCK + max(SIZES) - 1)
                    own = np.clip(off[a:z + 1], lo, hi) - lo
                    for g, ok in gram_ids(buf[lo:hi], own, buckets):
                        sums = np.vstack([np.zeros((1, n_bits)), np.cumsum(
                            m.weights[g] * ok[:, None], axis=0, dtype=np.float64)])
                        seen = np.append(0, np.cumsum(ok))
                        at = np.minimum(own, len(g))
                        total[a:z] += sums[at[1:]] - sums[at[:-1]]
                        n[a:z] += seen[at[1:]] - seen[at[:-1]]
            letters = np.array(b.column(2).to_pylist(), bool)
            if not m.langs:
                pred, score, second = [UNKNOWN] * len(n), np.zeros(len(n)), np.zeros(len(n))
            else:
                best, score, second = decode(m, total / np.maximum(n, 1)[:, None])
                pred = [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, letters)]
            score, second = np.where(letters, score, 0.0), np.where(letters, second, 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(3), pa.array(pred, pa.string()), pa.array(score),
                 pa.array(letters & (score < ambiguous))], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return small_batches(docs).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, held_out: Column, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not ``held_out`` and have a language, and
    answer for all rows."""
    t = F.coalesce(F.lower(F.col(text)), F.lit(""))
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), t.cast("binary").alias("t"), F.col(lang).alias("lang"),
                       F.coalesce(F.rlike(F.col(text), F.lit(r"\p{L}")), F.lit(False)).alias("letters"),
                       held_out.alias("held_out"))
    learn = rows.filter(~F.col("held_out") & F.col("lang").isNotNull()).select("t", "lang")
    return predict(rows.select("doc_id", "t", "letters", "held_out"), fit(count_grams(learn)))
