"""Exact removal of repeated passages with a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts in a
document with a smaller id, judged on the texts as they came; matches never
cross documents.

Suffixes are sampled: of each run of ``length`` bytes the positions whose next
``ANCHOR`` bytes hash lowest (minimizers) are kept, so equal strings keep equal
positions, about one byte in 14 is an entry, and every string of ``length``
bytes holds one.  Entries are ordered by the hash of their first ``ANCHOR``
bytes.

0. Of equal texts only those of the smallest id go on: a later one is all
   match, and adds none that the first doesn't give.
1. Entries are counted by slot of their hash; slots that hold far more than
   others, of passages many documents have or runs of equal bytes, are hot.
2. Entries of other slots go to shards by hash.  Within a shard, batches of entries get a
   sorted array each, are scanned in step with all existing levels for equal
   heads in other documents, and become a level; levels of like size merge
   (``Family``), so that an entry is merged a logarithmic number of times.
3. Entries with a head that several documents have go back to their documents,
   which cut the bytes around: all strings of ``length`` bytes that hold the
   entry lie in them.
4. Per head these strings are compared by a second, 64-bit hash of all their bytes;
   each but those of the smallest document is a match.
5. Strings that hold an entry of a hot slot stay where their text is: two 64-bit
   hashes of each are reduced to its smallest and greatest document, first per
   block of texts, then per task, then over all, and joined back.
6. Documents lose the union of their matches.

All but 5 are Spark shuffles of packed blocks; a task holds one shard, the number
of shards follows the size of the input, and no head has more entries in a shard
than a slot may hold.

Defined cases: a null text is empty; texts under ``length`` bytes lose nothing;
rows that share an id never remove from each other (they are told apart by a
hash of their texts, the column ``k``); a null id comes after all
others; long texts are worked on in overlapping pieces; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.llm import tokens
from txnrisk.llm.columns import small_batches, written
from txnrisk.operators.joins import broadcast_table, sized

LENGTH = 50
ANCHOR = 24
#: Entries of a shard in step 2, cut-outs of a shard in step 4, entries of a batch.
SHARD_ENTRIES = 400_000
SHARD_CUTS = 40_000
BATCH = 1 << 16
#: Slots of heads, slots that are summed in one group, and the entries (or the
#: multiple of the mean) beyond which a slot is hot.
SLOTS = 1 << 20
SLOT_GROUP = 1 << 11
HOT_ENTRIES = 40_000
HOT_MEANS = 4
NO_ID = (1 << 63) - 1
#: Files of a table of spans that may be broadcast; in memory it is many times as large.
SPANS_MAX_FILE_BYTES = 4 << 20


def head_hashes(buf: np.ndarray, n: int = ANCHOR, seed: int = 0) -> np.ndarray:
    """Hash of the ``n`` bytes at each position (none beyond the last): hashes
    of 1, 2, 4, ... bytes by doubling, put together by the bits of ``n``."""
    if len(buf) < n:
        return np.zeros(0, np.uint64)
    last = len(buf) - n + 1
    part = tokens.mix(buf.astype(np.uint64) + np.uint64(1 + (seed << 8)))
    power, size, done = np.uint64(0x9E3779B97F4A7C15 + (seed << 17)), 1, 0
    out = np.zeros(last, np.uint64)
    while True:
        if n & size:
            out = out * power + part[done:done + last]
            done += size
        if done == n:
            return tokens.mix(out)
        part = part[:-size] * power + part[size:]
        power = np.uint64(int(power) ** 2 % (1 << 64))
        size *= 2


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """``op`` over each ``n`` neighbours."""
    size, out = 1, x
    while size * 2 <= n:
        out = op(out[:-size], out[size:])
        size *= 2
    return op(out[:len(x) - n + 1], out[n - size:]) if n > size else out


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of the rows at ``off`` (from 0), and their hashes."""
    w = length - ANCHOR + 1
    if len(buf) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = head_hashes(buf) | np.uint64(1)
    left = np.repeat(off[1:], np.diff(off))[:len(buf) - length + 1] - np.arange(len(buf) - length + 1)
    low = np.where(left >= length, _slide(h, w, np.minimum), np.uint64(0))  # 0: no string of that length starts here
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), w, np.maximum) == h)
    return at, tokens.mix(h[at])


class Family:
    """Levels of sorted (head, least document, greatest document), each at
    least twice as large as the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.shared: list[np.ndarray] = []

    @staticmethod
    def _array(head: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(head, kind="stable")
        head = head[order]
        first = np.flatnonzero(np.append(True, head[1:] != head[:-1])[:len(head)])
        if not len(first):
            return head, low, high
        return head[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)

    def add(self, head: np.ndarray, doc: np.ndarray) -> None:
        new = self._array(head, doc, doc)
        self.shared.append(new[0][new[1] != new[2]])
        for level in self.levels:
            at = np.minimum(np.searchsorted(level[0], new[0]), len(level[0]) - 1)
            hit = (level[0][at] == new[0]) & ((level[1][at] != new[1]) | (level[2][at] != new[2]))
            self.shared.append(new[0][hit])
        while self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            new = self._array(*(np.concatenate(x) for x in zip(self.levels.pop(), new)))
        if len(new[0]):
            self.levels.append(new)

    def shared_heads(self) -> np.ndarray:
        return np.unique(np.concatenate(self.shared)) if self.shared else np.zeros(0, np.uint32)


def _pieces(off: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """``(a, z, lo, hi)``: rows a to z, bytes lo to hi; a long row comes in
    pieces that share ``length - 1`` bytes."""
    for a, z in tokens.row_blocks(off):
        lo, end = int(off[a]), int(off[z])
        while end - lo > 2 * tokens.BLOCK:
            yield a, z, lo, lo + tokens.BLOCK + length - 1
            lo += tokens.BLOCK
        yield a, z, lo, end


def _packed(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0)[:len(order)])
    columns = [c[order] for c in columns]
    for a, z in zip(cut, np.append(cut[1:], len(order))):
        yield int(shard[order[a]]), [c[a:z].tobytes() for c in columns]


def _joined(t: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]


def _anchored(b: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch ``(doc_id, k, t)`` that hold anchors: bytes, offsets of
    the rows in them, the first row, places of the rows' starts in them (before
    0 in a later piece of a row), anchors and their hashes."""
    buf, off = tokens.column_bytes(b.column(2))
    for a, z, lo, hi in _pieces(off, length):
        own = np.clip(off[a:z + 1], lo, hi) - lo
        at, h = anchors(buf[lo:hi], own, length)
        if len(at):
            yield buf[lo:hi], own, a, off[a:z] - lo, at, h


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def hot_slots(docs: DataFrame, length: int = LENGTH, hot_entries: int | None = None) -> np.ndarray:
    """Slots of ``docs(doc_id, k, t)`` with more than ``hot_entries`` entries and
    ``HOT_MEANS`` times the mean; each partition sends one number a slot."""
    least = HOT_ENTRIES if hot_entries is None else hot_entries

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            for *_, h in _anchored(b, length):
                n += np.bincount(_slot(h), minlength=SLOTS)
        groups = n.reshape(-1, SLOT_GROUP)
        some = np.flatnonzero(groups.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([groups[i].tobytes() for i in some], pa.binary())], ["part", "n"])

    def add(t: pa.Table) -> pa.Table:
        n = np.zeros(SLOT_GROUP, np.int64)
        for x in _joined(t, "n", np.int64):
            n += x
        many = np.flatnonzero(n > least)
        return pa.table({"slot": pa.array(np.append(t.column("part")[0].as_py() * SLOT_GROUP + many, -1)),
                         "n": pa.array(np.append(n[many], n.sum()))})

    counts = written(small_batches(docs).mapInArrow(count, "part long, n binary").groupBy("part").applyInArrow(
        add, "slot long, n long"), "suffix-slots")
    total = counts.filter("slot < 0").agg(F.sum("n")).first()[0] or 0
    hot = counts.filter((F.col("slot") >= 0) & (F.col("n") > HOT_MEANS * total / SLOTS))
    return hot.select("slot").toPandas()["slot"].to_numpy(np.int64)  # SLOTS / HOT_MEANS at most


def _mask(slots: np.ndarray) -> np.ndarray:
    out = np.zeros(SLOTS, bool)
    out[slots] = True
    return out


def entries(docs: DataFrame, shards: int, length: int = LENGTH, hot: np.ndarray | None = None) -> DataFrame:
    """``docs(doc_id, k, t)`` to packed entries ``(shard, head, doc, k, pos)`` outside
    the slots ``hot``; 32 bits of a head beside the shard's are kept: a chance
    match costs a comparison."""
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.int64) if hot is None else hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = _mask(shared.value)
        for b in batches:
            ids, ks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for _, own, a, begin, at, h in _anchored(b, length):
                cold = ~mask[_slot(h)]
                at, h = at[cold], h[cold]
                if not len(at):
                    continue
                row = np.searchsorted(own, at, side="right") - 1
                pos = (at - begin[row]).astype(np.int32)
                row += a
                rows = [*_packed((h >> np.uint64(32)).astype(np.int64) % shards, h.astype(np.uint32), ids[row], ks[row], pos)]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows]), *[
                    pa.array([c[i] for _, c in rows], pa.binary()) for i in range(4)]], ["shard", "head", "doc", "k", "pos"])

    return small_batches(docs).mapInArrow(run, "shard long, head binary, doc binary, k binary, pos binary")


def _around(buf: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the strings that start at the ascending ``start``, neighbours
    in one piece, and the places of the starts in them; ``buf`` itself where that is shorter."""
    first = np.flatnonzero(np.append(True, np.diff(start) > 1))
    n = np.diff(np.append(first, len(start)))
    size = n + length - 1
    if size.sum() >= len(buf):
        return buf, start
    begin = np.cumsum(size) - size
    return (buf[np.repeat(start[first] - begin, size) + np.arange(size.sum())],
            start + np.repeat(begin - start[first], n))


def _hot_strings(b: pa.RecordBatch, length: int, mask: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start in the row and two hashes of each string of ``length`` bytes
    that holds an anchor of a hot slot, a piece at a time."""
    for buf, own, a, begin, at, h in _anchored(b, length):
        at = at[mask[_slot(h)]]
        row = np.searchsorted(own, at, side="right") - 1
        lo, hi = np.maximum(at - (length - ANCHOR), own[row]), np.minimum(at, own[row + 1] - length)
        step = np.zeros(len(buf) + 1, np.int64)
        np.add.at(step, lo[lo <= hi], 1)
        np.add.at(step, hi[lo <= hi] + 1, -1)
        start = np.flatnonzero(np.cumsum(step))
        if len(start):
            row = np.searchsorted(own, start, side="right") - 1
            near, place = _around(buf, start, length)
            yield row + a, start - begin[row], *(head_hashes(near, length, s)[place].view(np.int64) for s in (0, 1))


def _firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by all columns, and where in it a new combination starts."""
    by = np.lexsort(columns[::-1])
    new = np.zeros(max(0, len(by) - 1), bool)
    for c in columns:
        new |= c[by[1:]] != c[by[:-1]]
    return by, np.flatnonzero(np.append(True, new))


def hot_matches(docs: DataFrame, hot: np.ndarray, length: int = LENGTH) -> DataFrame:
    """``(doc_id, k, pos, starts)`` as ``matches`` has it, for the strings that hold
    an entry of the slots ``hot``.  Texts are read twice instead of written:
    for the smallest document of each string, then to find those of others."""
    side = length - ANCHOR
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = _mask(shared.value)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for row, _, h1, h2 in _hot_strings(b, length, mask):
                by, at = _firsts(h1, h2)
                doc = ids[row[by]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    h1[by[at]], h2[by[at]], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at))], ["h1", "h2", "low", "high"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = _mask(shared.value)
        for b in batches:
            ids, ks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, start, h1, h2 in _hot_strings(b, length, mask):
                cell = start // (side + 1)
                by, at = _firsts(row, h1, h2, cell)
                bits = np.bitwise_or.reduceat(np.int64(1) << (start - cell * (side + 1))[by], at)
                one = by[at]
                pos = (cell[one] * (side + 1) + side).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    ids[row[one]], ks[row[one]], h1[one], h2[one], pos, bits)], ["doc_id", "k", "h1", "h2", "pos", "starts"])

    least = written(small_batches(docs).mapInArrow(reduce, "h1 long, h2 long, low long, high long").groupBy("h1", "h2").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("h1", "h2", "low"), "suffix-strings")
    marks = small_batches(docs).mapInArrow(mark, "doc_id long, k long, h1 long, h2 long, pos int, starts long")
    return marks.join(broadcast_table(least, SPANS_MAX_FILE_BYTES), ["h1", "h2"]).filter("doc_id > low").groupBy(
        "doc_id", "k", "pos").agg(F.bit_or("starts").alias("starts"))


def shared_entries(packed: DataFrame) -> DataFrame:
    """``(doc_id, k, pos)`` of entries whose head several documents have."""
    def run(t: pa.Table) -> pa.Table:
        heads, docs = _joined(t, "head", np.uint32), _joined(t, "doc", np.int64)
        ks, places = _joined(t, "k", np.int64), _joined(t, "pos", np.int32)
        family, held, size = Family(), [], 0
        for i, h in enumerate(heads):
            held.append(i)
            size += len(h)
            if size >= BATCH or i == len(heads) - 1:
                family.add(np.concatenate([heads[j] for j in held]), np.concatenate([docs[j] for j in held]))
                held, size = [], 0
        known = family.shared_heads()
        hits = [known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                for h in heads]
        return pa.table({n: pa.array(np.concatenate([x[hit] for x, hit in zip(c, hits)]))
                         for n, c in (("doc_id", docs), ("k", ks), ("pos", places))})

    return packed.groupBy("shard").applyInArrow(run, "doc_id long, k long, pos int")


def cut_outs(texts: DataFrame, shards: int, length: int = LENGTH) -> DataFrame:
    """``texts(doc_id, k, t, pos)`` to packed ``(shard, head, doc, k, pos, left,
    right, cut)``: the bytes around each position, ``length - ANCHOR`` to each side
    where the text has them."""
    side = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ks = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buf, off = tokens.column_bytes(b.column(2))
            places = b.column(3)
            n = np.diff(np.frombuffer(places.buffers()[1], np.int32)[places.offset:places.offset + len(places) + 1])
            row, pos = np.repeat(np.arange(len(ids)), n), places.flatten().to_numpy().astype(np.int64)
            for a in range(0, len(row), SHARD_CUTS):
                r, p = row[a:a + SHARD_CUTS], pos[a:a + SHARD_CUTS]
                left = np.minimum(p, side)
                right = np.minimum(off[r + 1] - off[r] - p - ANCHOR, side)
                where = (off[r] + p)[:, None] + np.arange(-side, length)
                cut = buf[np.clip(where, 0, len(buf) - 1)]
                h = np.zeros(len(r), np.uint64)
                for j in range(side, length):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + tokens.mix(cut[:, j].astype(np.uint64) + np.uint64(1))
                h = tokens.mix(h)
                reach = np.arange(-side, length)
                cut[(reach < -left[:, None]) | (reach >= ANCHOR + right[:, None])] = 0
                rows = [*_packed((h >> np.uint64(32)).astype(np.int64) % shards, h, ids[r], ks[r], p.astype(np.int32),
                                 left.astype(np.uint8), right.astype(np.uint8), cut)]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows]), *[
                    pa.array([c[i] for _, c in rows], pa.binary()) for i in range(7)]],
                    ["shard", "head", "doc", "k", "pos", "left", "right", "cut"])

    return texts.mapInArrow(run, "shard long, head binary, doc binary, k binary, pos binary, left binary, right binary, cut binary")


def matches(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, k, pos, starts)``: bit o of ``starts`` says that the string of
    ``length`` bytes from ``pos - (length - ANCHOR) + o`` also starts in a smaller document."""
    side = length - ANCHOR

    def run(t: pa.Table) -> pa.Table:
        cat = lambda name, kind: np.concatenate(_joined(t, name, kind))
        head, doc, k, pos = cat("head", np.uint64), cat("doc", np.int64), cat("k", np.int64), cat("pos", np.int32)
        left, right = cat("left", np.uint8).astype(int), cat("right", np.uint8).astype(int)
        cut = cat("cut", np.uint8).reshape(len(head), length + side)
        lone = np.zeros(len(head), np.int64)
        code = tokens.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        base = np.uint64(0xA0761D6478BD642F)
        for order in _head_groups(head):  # roll the hash of ``length`` bytes over the cut-outs
            near = cut[order].T.copy()  # a row per place, so that a step reads one
            h = np.zeros(len(order), np.uint64)
            for j in range(length):
                h = h * base + code[near[j]]
            out = np.uint64(pow(int(base), length, 1 << 64))
            for o in range(side + 1):
                ok = np.flatnonzero((o >= side - left[order]) & (o <= right[order]))
                if len(ok):
                    key = tokens.mix(h[ok]) ^ head[order[ok]]
                    by = np.lexsort((doc[order[ok]], key))
                    key, d = key[by], doc[order[ok]][by]
                    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    least = np.repeat(d[start], np.diff(np.append(start, len(key))))
                    lone[order[ok][by[d > least]]] |= 1 << o
                if o < side:
                    h = h * base + code[near[o + length]] - code[near[o]] * out
        hit = np.flatnonzero(lone)
        return pa.table({"doc_id": pa.array(doc[hit]), "k": pa.array(k[hit]), "pos": pa.array(pos[hit]),
                         "starts": pa.array(lone[hit])})

    return packed.groupBy("shard").applyInArrow(run, "doc_id long, k long, pos int, starts long")


def _head_groups(head: np.ndarray, rows: int = SHARD_CUTS) -> Iterator[np.ndarray]:
    """Indices in runs of about ``rows``, those of a head together."""
    order = np.argsort(head, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(head[order]) != 0)[:len(order)])
    ends = np.append(start[1:], len(order))
    a = 0
    for end in ends:
        if end - a >= rows or end == len(order):
            yield order[a:end]
            a = end


SPANS = "array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def runs(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, k, spans)``: the union of each document's matches."""
    side = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for f in b.column(2):
                v = f.values
                bits = (v.field("starts").to_numpy()[:, None] >> np.arange(side + 1)) & 1
                r, o = np.nonzero(bits)
                starts = np.unique(v.field("pos").to_numpy().astype(np.int64)[r] - side + o)
                new = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + length))
                ends = np.append(starts[new[1:] - 1], starts[-1]) + length
                spans.append([{"start": x, "end": y} for x, y in zip(starts[new].tolist(), ends.tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _SPANS)], ["doc_id", "k", "spans"])

    lists = found.groupBy("doc_id", "k").agg(F.collect_list(F.struct("pos", "starts")).alias("found"))
    return lists.mapInArrow(run, f"doc_id long, k long, spans {SPANS}")


def remove(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, t, spans)`` to ``(doc_id, n_bytes, spans, kept)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, sizes = [], []
            for t, spans in zip(b.column(1), b.column(2).to_pylist()):
                view, at, parts = memoryview(t.as_buffer()), 0, []
                for s in spans:
                    parts.append(view[at:s["start"]])
                    at = s["end"]
                kept.append(b"".join((*parts, view[at:])))
                sizes.append(len(view))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(2), pa.array(kept, pa.binary())],
                                             ["doc_id", "n_bytes", "spans", "kept"])

    return small_batches(texts).mapInArrow(run, f"doc_id long, n_bytes long, spans {SPANS}, kept binary")


def dedup(docs: DataFrame, length: int = LENGTH, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every row."""
    if not ANCHOR < length <= ANCHOR + 62:
        raise ValueError(f"length must be over {ANCHOR} and at most {ANCHOR + 62} bytes")
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    names = written(rows.select("doc_id", F.xxhash64("t").alias("k"), F.sha2("t", 256).alias("text_hash"),
                                F.octet_length("t").alias("n")), "suffix-texts")
    if names.groupBy("doc_id").count().filter("count > 1").isEmpty():
        names, rows = names.withColumn("k", F.lit(0).cast("long")), rows.withColumn("k", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("k", F.xxhash64("t"))
    first = names.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = written(names.join(sized(first.select("text_hash", "first")), "text_hash").filter(
        "doc_id > first").select("doc_id", "k", F.lit(True).alias("copy")).distinct(), "suffix-copies")
    own = rows.join(broadcast_table(copies, SPANS_MAX_FILE_BYTES), ["doc_id", "k"], "left_anti").select("doc_id", "k", "t")
    total = names.agg(F.sum("n")).first()[0] or 0
    shards = max(32, -(-2 * total // (length - ANCHOR + 2) // SHARD_ENTRIES))
    hot = hot_slots(own, length)
    shared = written(shared_entries(entries(own, shards, length, hot)), "suffix-shared")
    places = shared.groupBy("doc_id", "k").agg(F.collect_list("pos").alias("pos"))
    cuts = cut_outs(own.join(places, ["doc_id", "k"]).select("doc_id", "k", "t", "pos"),
                    max(32, -(-shared.count() // SHARD_CUTS)), length)
    same = matches(cuts, length)
    if len(hot):
        same = same.unionByName(hot_matches(own, hot, length))
    found = written(runs(same, length), "suffix-found")
    out = rows.join(broadcast_table(copies, SPANS_MAX_FILE_BYTES), ["doc_id", "k"], "left").join(
        broadcast_table(found, SPANS_MAX_FILE_BYTES), ["doc_id", "k"], "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("t").cast("long").alias("end")))
    spans = F.when(F.col("copy") & (F.octet_length("t") >= length), whole).otherwise(
        F.coalesce("spans", F.array().cast(SPANS.replace(":long", ":bigint"))))
    return remove(out.select("doc_id", "t", spans.alias("spans"))).withColumn(
        "doc_id", F.nullif("doc_id", F.lit(NO_ID)))
