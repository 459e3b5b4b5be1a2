"""Benchmark decontamination by greedy string tiling.

A document is tainted by a test item if tiles cover at least ``threshold`` of
the item's tokens.  A tile is a run of ``min_match`` or more equal tokens of
both, and no token is in two tiles; the longest runs are taken first
(ties: the earlier in the document, then in the item).  As tiles may lie in any order, moved
passages count like copied ones.

Steps: (1) every document's hashes of ``min_match`` tokens (Karp-Rabin windows)
are looked up among those of the items; documents keep their hits.  (2) Hits
join the items' seeds; a pair goes on if its shared seeds cover enough
of the item, which tiles never exceed.  (3) For each pair left, windows that
continue each other on a diagonal give all maximal runs, and tiling picks
longest ones again and again, cutting runs that overlap a tile.

The lookup broadcasts at most ``SEED_BLOCK`` seeds; a larger benchmark is taken
in blocks of that size, each against all documents.  Tokens are runs of letters
and digits in lower case.

Defined cases: a null or empty text has no tokens and is never tainted, nor
does a null or empty item taint; items shorter than ``min_match`` tokens are
too short to tell and never match; repeated rows, of either table, are judged
each for itself; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm import tokens
from txnrisk.llm.columns import small_batches
from txnrisk.session import cut_lineage

MIN_MATCH = 5
THRESHOLD = 0.5
SEED_BLOCK = 2_000_000
HITS = "doc_id long, row long, pos array<int>, seed array<long>"
TILES = ("doc_id long, item_id long, coverage double, n_tiles int, longest int, "
         "tiles array<struct<doc_pos:int,item_pos:int,length:int>>")


def normal(text: Column) -> Column:
    """Lower-case tokens, one blank between, as bytes."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit("")).cast("binary")


def _windows(buf: np.ndarray, off: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of rows: rows, positions and hashes of all token windows, and rows' token counts."""
    for a, b in tokens.row_blocks(off):
        h, s, _ = tokens.words(buf[off[a]:off[b]], off[a:b] - off[a])
        first = np.searchsorted(s, off[a:b + 1] - off[a])
        g = tokens.grams(h, k)
        row = np.repeat(np.arange(a, b), np.diff(first))
        inside = np.arange(len(g)) + k <= first[1:][row[:len(g)] - a] if len(g) else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        yield row[at], (at - first[row[at] - a]).astype(np.int32), g[at], np.diff(first)


def _lists(row: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def item_seeds(items: DataFrame, k: int, item: str, text: str) -> DataFrame:
    """``(item_id, item_row, n_tokens, seeds)``, one row per item of at least ``k`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = tokens.column_bytes(b.column(1))
            at = 0
            for row, _, g, n in _windows(buf, off, k):
                part = b.column(0).slice(at, len(n))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(n.astype(np.int32)), _lists(row - at, len(n), pa.array(g.view(np.int64)))],
                    ["item_id", "n_tokens", "seeds"])
                at += len(n)

    rows = items.select(F.col(item).cast("long").alias("item_id"), normal(F.col(text)).alias("t")).mapInArrow(
        run, "item_id long, n_tokens int, seeds array<long>")
    return cut_lineage(rows.filter(F.size("seeds") > 0).withColumn("item_row", F.monotonically_increasing_id()), "gst-items")


def seed_hits(docs: DataFrame, known: np.ndarray, k: int, doc: str, text: str) -> DataFrame:
    """Documents that hold one of the seeds ``known`` (sorted), with places and seeds."""
    shared = docs.sparkSession.sparkContext.broadcast((known, tokens.low_bits(known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, bitmap = shared.value
        for b in batches:
            buf, off = tokens.column_bytes(b.column(1))
            for row, pos, g, _ in _windows(buf, off, k):
                hit = tokens.in_sorted(g, seeds, bitmap)
                if len(hit):
                    rows, inverse = np.unique(row[hit], return_inverse=True)
                    lists = [_lists(inverse, len(rows), pa.array(x)) for x in (pos[hit], g[hit].view(np.int64))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *lists], ["doc_id", "pos", "seed"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), normal(F.col(text)).alias("t"))
    return cut_lineage(small_batches(rows).mapInArrow(run, "doc_id long, pos array<int>, seed array<long>").withColumn(
        "row", F.monotonically_increasing_id()), "gst-hits")


def runs(pos: np.ndarray, seed: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal runs of equal tokens, ``(length, document place, item place)``:
    windows that match and continue each other on one diagonal."""
    order = np.argsort(item, kind="stable")
    lo = np.searchsorted(item[order], seed)
    n = np.searchsorted(item[order], seed, side="right") - lo
    i = np.repeat(pos.astype(np.int64), n)
    j = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(i))) + k - 1
    return [*zip(length.tolist(), i[start].tolist(), j[start].tolist())]


def tile(found: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal runs: the longest goes first, others lose the
    tokens it took; what is left of them stays if it has ``k`` tokens."""
    heap = [(-n, i, j) for n, i, j in found]
    heapq.heapify(heap)
    used_doc: set[int] = set()
    used_item: set[int] = set()
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [i + x not in used_doc and j + x not in used_item for x in range(n)]
        if all(free):
            out.append((i, j, n))
            used_doc.update(range(i, i + n))
            used_item.update(range(j, j + n))
            continue
        x = 0
        while x < n:
            y = x
            while y < n and free[y]:
                y += 1
            if y - x >= k:
                heapq.heappush(heap, (x - y, i + x, j + x))
            x = y + 1
    return sorted(out)


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_match: int = MIN_MATCH,
            doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
            seed_block: int = SEED_BLOCK) -> DataFrame:
    """Tainted documents, one row per (document, item): ``TILES``."""
    k = min_match
    known = item_seeds(items, k, item, item_text)
    total = known.agg(F.sum(F.size("seeds"))).first()[0] or 0
    parts = max(1, -(-total // seed_block))
    found = None
    for part in range(parts):
        mine = known.filter(F.pmod(F.xxhash64("item_row"), F.lit(parts)) == part) if parts > 1 else known
        block = _matches(docs, mine, threshold, k, doc, text)
        found = block if found is None else found.unionByName(block)
    return found


def _matches(docs: DataFrame, known: DataFrame, threshold: float, k: int, doc: str, text: str) -> DataFrame:
    seeds = known.select("item_row", "n_tokens", F.posexplode("seeds").alias("p", "seed"))
    values = known.select(F.explode("seeds").alias("s")).distinct().toPandas()["s"]  # a block of seeds at most
    hits = seed_hits(docs, np.sort(values.to_numpy(np.int64).view(np.uint64)), k, doc, text)
    covered = F.size(F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(p, p + k - 1)))))
    pairs = (hits.select("row", F.explode(F.array_distinct("seed")).alias("seed"))
             .join(F.broadcast(seeds), "seed")  # a block of seeds at most
             .groupBy("row", "item_row", "n_tokens").agg(F.collect_set("p").alias("ps"))
             .filter(covered >= F.lit(threshold) * F.col("n_tokens")).select("row", "item_row"))
    both = pairs.join(hits, "row").join(F.broadcast(known), "item_row").select(
        "doc_id", "item_id", "n_tokens", "pos", "seed", "seeds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, item_id, n, pos, seed, item in zip(*(b.column(c) for c in range(6))):
                tiles = tile(runs(pos.values.to_numpy(), seed.values.to_numpy(), item.values.to_numpy(), k), k)
                share = sum(x[2] for x in tiles) / n.as_py()
                if share >= threshold:
                    rows.append({"doc_id": doc_id.as_py(), "item_id": item_id.as_py(), "coverage": share, "n_tiles": len(tiles),
                                 "longest": max(x[2] for x in tiles), "tiles": [
                                     {"doc_pos": i, "item_pos": j, "length": m} for i, j, m in tiles]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()),
                    ("longest", pa.int32()), ("tiles", pa.list_(pa.struct([
                        ("doc_pos", pa.int32()), ("item_pos", pa.int32()), ("length", pa.int32())])))]))

    return both.mapInArrow(run, TILES)
