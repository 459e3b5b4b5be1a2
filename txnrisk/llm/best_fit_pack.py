"""Packing of tokenized documents into sequences of fixed size, with few sequences.

A document's ids, and an end id, are cut only where they exceed a sequence:
into whole sequences, the first piece may be shorter.  Pieces of one length are
alike, so the whole instance is a histogram of at most ``size`` counts, whatever
the number of documents.  On it the driver

* reduces by dominance (Martello and Toth): for a piece of the largest lengths it
  looks for a set of up to three pieces that dominates every other feasible
  set with that piece -- what a dominated set holds could be exchanged, piece
  by piece, for pieces no smaller -- and fixes it for good, as often as there are
  such pieces; what is left is a smaller instance, which is reduced again;
* packs the remainder by best fit, largest first; a step deals all pieces of
  one length to the bins of one residue.

The result is a plan: for each length, which ranks go where.  Kinds of bins arise
only by splitting one kind per length and residue, so the plan's rows are bounded by
the sequence size, not by the documents; it is broadcast, and pieces look up
their rank in it.

Spark tokenizes where the text is and writes one row a piece, with its number
among those of its length in its task; counts by task and length make that a
rank.  Nothing is sorted, and texts are not shuffled.

Tokens come from the tokenizer's file by ``tokenizers``.  A text is cut before
white space that follows other characters and between a letter and an ASCII
mark, where its byte-level pre-tokenizer always cuts, and each such word is tokenized
once and remembered (``CACHE`` words a worker, then anew): the ids are those of the whole text.

Defined cases: a null text is empty, and an empty document is its end id alone;
rows that repeat an id are packed each for itself; an empty table gives no rows;
other columns are ignored; a long text is worked through in blocks of ``BLOCK``
characters (more only where it has no white space), its ids are held whole.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.llm.columns import small_batches, written
from txnrisk.operators.joins import sized

SIZE = 2048
END = 0
BLOCK = 1 << 18
CACHE = 1 << 20
#: a longer word is not remembered
WORD = 64
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: letters of \\p{L}, and ASCII that isn't; between the two a pre-token always ends
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
MARK = "\\x00-\\x08\\x0e-\\x1f!-@\\[-`{-\\x7f"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, ord long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: rows of (task, length) counts that may be broadcast
BROADCAST_ROWS = 500_000
#: a plan's key is the length above the rank
_RANK_BITS = 44


# --- tokens -------------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in a byte-level vocabulary: printable Latin-1 as it is, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + others.index(b)) for b in range(256)}


class Words:
    """Ids of texts as little-endian 32-bit bytes, word by word."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # words are remembered here
        # letters before a blank or an ASCII mark, the rest up to the next such place, or blanks
        self.words = re.compile(f"[{WHITE}]*[{LETTER}]+(?![^{MARK}{WHITE}])|[{WHITE}]*[^{WHITE}]+?"
                                f"(?:(?<=[{LETTER}])(?=[{MARK}])|(?=[{WHITE}])|\\Z)|[{WHITE}]+").findall
        self.plain = re.compile(f" ?[{LETTER}]+").fullmatch
        self.edge = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")
        added = {t.content: np.array([i], "<u4").tobytes() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added, self.at_added = added, re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.known = _Known(self)

    def ids(self, text: str) -> bytes:
        if any(a in text for a in self.added):  # tokens of their own, in ordinary texts as well
            return b"".join([self.added.get(part) or self.ids(part) for part in self.at_added.split(text) if part])
        if len(text) <= BLOCK:
            return self._block(text)
        out, at = [], 0
        while at < len(text):
            cut = self.edge.search(text, at + BLOCK) if at + BLOCK < len(text) else None
            end = cut.start() if cut else len(text)
            out.append(self._block(text[at:end]))
            at = end
        return b"".join(out)

    def _block(self, text: str) -> bytes:
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self.words(text)))

    def word(self, w: str) -> bytes:
        if self.plain(w):  # the pre-tokenizer leaves it whole
            if w.isascii():
                shown = self.letters[32] + w[1:] if w[0] == " " else w
            else:
                shown = w.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(shown)]
        else:
            ids = self.tokenizer.encode(w, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """Words and their ids; a word asked for the first time is tokenized."""

    def __init__(self, words: Words):
        self.tokenized = words.word

    def __missing__(self, w: str) -> bytes:
        ids = self.tokenized(w)
        if len(w) <= WORD:
            self[w] = ids
        return ids


def _words(tokenizer_file: str) -> Words:
    """This worker process's ``Words``.  Functions travel by value, with globals of their
    own for each task, so what outlives a task is kept in a module made here."""
    kept = sys.modules.setdefault("_best_fit_pack_words", types.ModuleType("_best_fit_pack_words")).__dict__
    if tokenizer_file not in kept:
        kept[tokenizer_file] = Words(tokenizer_file)
    return kept[tokenizer_file]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids."""
    first = n % size or min(n, size)
    return [(0, first)] + [(start, size) for start in range(first, n, size)]


def _tokenizer(tokenizer_file: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, counts = _words(tokenizer_file), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        last = np.array([end], "<u4").tobytes()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = words.ids(text.as_py() or "") + last
                for piece, (start, n) in enumerate(cut(len(ids) // 4, size)):
                    out.append((doc, piece, start, n, zlib.crc32(ids[4 * start:4 * (start + n)]), part, int(counts[n])))
                    counts[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "ord"])
    return run


def pieces(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end: int = END, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``PIECES`` as a written table."""
    rows = small_batches(docs).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(rows.mapInArrow(_tokenizer(tokenizer_file, size, end), PIECES), "pack-pieces")


# --- the plan -----------------------------------------------------------------------

Kind = tuple[int, int, list[tuple[int, int]]]
"""Bins alike: (how many, what is free in each, [(length, times), ...])."""


def _smallest(left: list[int], start: int, stop: int, n: int) -> list[int]:
    """The ``n`` smallest pieces (fewer if there are) from ``start`` to ``stop``."""
    out: list[int] = []
    for w in range(start, stop + 1):
        out += [w] * min(n - len(out), left[w])
        if len(out) == n:
            break
    return out


def _dominating(left: list[int], j: int, size: int) -> list[int] | None:
    """Lengths of a set that dominates all feasible sets with a piece of length
    ``j``, or None where none of up to three pieces is known to.
    ``left``: pieces by length, that of ``j`` taken out."""
    room = size - j
    big = next((w for w in range(room, 0, -1) if left[w]), 0)
    if not big:
        return [j]
    if big == room:  # fills the bin: whatever else goes with j fits into big's place
        return [j, big]
    low = _smallest(left, 1, room, 3)
    if len(low) < 2 or low[0] + low[1] > room:  # one more piece at most
        return [j, big]
    if len(low) == 3 and sum(low) <= room:
        return None
    lengths = [w for w in range(1, room + 1) if left[w]]
    best, a, b = 0, 0, 0  # two more at most: the pair that fills most
    up = len(lengths) - 1
    for down in range(len(lengths)):
        while up >= 0 and lengths[down] + lengths[up] > room:
            up -= 1
        if up < down:
            break
        at = up if up > down or left[lengths[up]] > 1 else -1
        if at >= 0 and lengths[down] + lengths[at] > best:
            best, a, b = lengths[down] + lengths[at], lengths[at], lengths[down]
    if big >= best:
        return [j, big]
    above = _smallest(left, b + 1, room, 2)
    if big == a and (len(above) < 2 or sum(above) > room):  # no feasible pair has both over b
        return [j, a, b]
    return None


def reduce(counts: list[int], size: int) -> tuple[list[Kind], list[int]]:
    """Sets fixed by dominance, and the pieces left.  ``counts``: pieces by length."""
    left, fixed = [*counts], []
    again = True
    while again:
        again = False
        for j in range(size, 0, -1):
            while left[j]:
                left[j] -= 1
                found = _dominating(left, j, size)
                left[j] += 1
                if found is None:
                    break
                times = {w: found.count(w) for w in found}
                n = min(left[w] // t for w, t in times.items())  # it goes on to dominate while there are such pieces
                for w, t in times.items():
                    left[w] -= n * t
                fixed.append((n, size - sum(found), sorted(times.items(), reverse=True)))
                again = True
    return fixed, left


def best_fit(counts: list[int], size: int) -> list[Kind]:
    """Best fit decreasing: each piece goes to the fullest bin that takes it."""
    free: dict[int, list[Kind]] = {}  # by what is free

    def put(n: int, room: int, held: list[tuple[int, int]]) -> None:
        if n:
            free.setdefault(room, []).append((n, room, held))

    for w in range(size, 0, -1):
        c = counts[w]
        for room in sorted(r for r in free if r >= w):  # what stays free is less than w: no bin comes twice
            if not c:
                break
            for n, _, held in free.pop(room):
                most = room // w
                full = min(n, c // most)
                rest = c - full * most if full < n else 0
                put(full, room - most * w, [*held, (w, most)])
                put(1 if rest else 0, room - rest * w, [*held, (w, rest)])
                put(n - full - (1 if rest else 0), room, held)
                c -= full * most + rest
        most = size // w
        put(c // most, size - most * w, [(w, most)])
        put(1 if c % most else 0, size - c % most * w, [(w, c % most)])
    return [kind for kinds in free.values() for kind in kinds]


def plan(counts: list[int], size: int) -> dict[str, np.ndarray]:
    """Rows (length, first rank, first bin, times, offset) by length and rank: a
    piece of that rank goes to bin ``first + (rank - first rank) // times``."""
    fixed, left = reduce(counts, size)
    rows, taken, base = [], [0] * (size + 1), 0
    for n, _, held in [*fixed, *best_fit(left, size)]:
        offset = 0
        for w, times in held:
            rows.append((w, taken[w], base, times, offset))
            taken[w] += n * times
            offset += w * times
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << _RANK_BITS) + table[:, 1], "rank": table[:, 1], "base": table[:, 2], "times": table[:, 3],
            "offset": table[:, 4]}


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(p["key"], (length << _RANK_BITS) + rank, side="right") - 1
            nth = rank - p["rank"][at]
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(p["base"][at] + nth // p["times"][at]),
                                   pa.array(p["offset"][at] + nth % p["times"][at] * length)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_file: str, size: int = SIZE, end: int = END, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``PLACED``: the pieces of ``docs`` with their places in sequences of ``size`` ids."""
    spark = docs.sparkSession
    rows = pieces(docs, tokenizer_file, size, end, doc, text)
    by_task = rows.groupBy("part", "length").agg(F.count("*").alias("m"))
    before = written(by_task.select("part", "length", "m", (F.sum("m").over(
        Window.partitionBy("length").orderBy("part")) - F.col("m")).alias("before")), "pack-counts")
    counts = [0] * (size + 1)
    for w, n in before.groupBy("length").agg(F.sum("m")).collect():  # a row for each length at most
        counts[w] = n
    shared = spark.sparkContext.broadcast(plan(counts, size))
    ranked = rows.join(sized(before.drop("m"), materialize=False, max_rows=BROADCAST_ROWS), ["part", "length"])
    return ranked.withColumn("rank", F.col("before") + F.col("ord")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placer(shared), PLACED)
