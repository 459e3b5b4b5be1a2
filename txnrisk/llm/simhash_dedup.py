"""SimHash near-duplicates by BK-trees.

Fingerprints: every run of ``shingle`` words is hashed by XXH64, and a bit of
the 64 is set if more than half of the hashes have it.  Documents link at
``max_bits`` or fewer differing bits; groups are connected documents.

Search: two fingerprints that differ in at most r bits agree in at least one
of r + 1 blocks of their bits.  Each distinct fingerprint goes to the shards
named by its block values, and every shard holds a BK-tree: a child hangs below
its parent on the edge numbered by their Hamming distance, and a search within
radius r follows, from a node at distance d, only edges from d - r to d + r.
Trees stay where their queries are instead of being broadcast: they grow with
the data.  A partition builds and searches all its trees level by level with
numpy.  A block value that too many fingerprints share is cut again by the
same rule over the remaining bits.

A shard gives every fingerprint its smallest linked one (a star per group of
the shard), so copies and dense groups never become all pairs; stars of all
shards are joined to components by label propagation with pointer jumping on
written tables.

Defined cases: a null text is empty; a text without words has fingerprint 0,
which links like any other; fewer words than a shingle make one shingle;
repeated rows are documents of their own that share id and group; rows with a
null id are kept, and a group of such rows alone has a null component; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.columns import small_batches
from txnrisk.session import cut_lineage

WORDS = 3
MAX_BITS = 3
SEED = 42
#: Hashes that are held at once while the bits of a long text are counted.
HASH_BLOCK = 1 << 16
#: Fingerprints of one block value beyond which it is cut again.
SHARD_MAX = 20_000
#: (query, node) pairs held at once in a search.
FRONTIER = 1 << 20


def fingerprint(text: bytes, shingle: int = WORDS) -> int:
    from xxhash import xxh64_intdigest
    norm = b" ".join(text.lower().split())  # bytes: A-Z only, and the six ASCII blanks
    if not norm:
        return 0
    ends = np.append(np.flatnonzero(np.frombuffer(norm, np.uint8) == 32), len(norm))
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(ends) - shingle + 1)
    starts, ends = starts[:n], ends[min(shingle, len(ends)) - 1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, HASH_BLOCK):
        h = np.array([xxh64_intdigest(norm[a:b], SEED) for a, b in zip(
            starts[at:at + HASH_BLOCK].tolist(), ends[at:at + HASH_BLOCK].tolist())], np.uint64)
        counts += bit_counts(h)
    return int(np.packbits(counts[::-1] * 2 > n).view(">u8")[0])


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of ``h`` have bit i, for i from 0."""
    out = np.zeros(64, np.int64)
    for b, col in enumerate(h.astype("<u8").view(np.uint8).reshape(-1, 8).T):
        seen = np.bincount(col, minlength=256)
        out[8 * b:8 * b + 8] = seen @ BYTE_BITS
    return out


BYTE_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def fingerprints(docs: DataFrame, shingle: int = WORDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``; ``fp`` holds the 64 bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)
                            for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return small_batches(rows).mapInArrow(run, "doc_id long, fp long")


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [[*map(int, x)] for x in np.array_split(bits, parts)]


def _value(fp: Column, bits: list[int]) -> Column:
    """The bits ``bits`` of a fingerprint (neighbours), as a number."""
    return F.shiftrightunsigned(fp, bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1))


def shard_keys(fps: DataFrame, max_bits: int = MAX_BITS, shard_max: int = SHARD_MAX) -> DataFrame:
    """``(shard, fp)``: each fingerprint at the shard of each of its block
    values, at sub-shards where a block value is crowded."""
    parts = max_bits + 1
    blocks = _blocks([*range(64)], parts)
    first = fps.select("fp", F.explode(F.array(*[F.struct(
        F.lit(i).alias("block"), _value(F.col("fp"), b).alias("value")) for i, b in enumerate(blocks)])).alias("k")
    ).select("fp", "k.block", "k.value")
    crowded = cut_lineage(first.groupBy("block", "value").agg(F.count("*").alias("n")).filter(
        F.col("n") > shard_max).select("block", "value"), "simhash-crowded")
    if crowded.isEmpty():
        return first.select(F.xxhash64("block", "value").alias("shard"), "fp")
    from txnrisk.operators.joins import sized
    rest = {i: _blocks([x for j, o in enumerate(blocks) if j != i for x in o], parts) for i in range(parts)}

    def sub(i: int) -> Column:
        # a sub-block may straddle the gap that block i leaves: take it bit run by bit run
        out = []
        for j, bits in enumerate(rest[i]):
            runs = np.split(bits, np.flatnonzero(np.diff(bits) != 1) + 1)
            out.append(F.xxhash64(F.lit(i), F.col("value"), F.lit(j), *[_value(F.col("fp"), [*map(int, r)]) for r in runs]))
        return F.array(*out)

    marked = first.join(sized(crowded.withColumn("hot", F.lit(True))), ["block", "value"], "left")
    keys = F.array(F.xxhash64("block", "value"))
    for i in range(parts):
        keys = F.when(F.col("hot") & (F.col("block") == i), sub(i)).otherwise(keys)
    return marked.select(F.explode(keys).alias("shard"), "fp")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class BKForest:
    """BK-trees of many shards, in arrays.  ``items`` are sorted by shard; the
    first item of a shard is its root.  Distinct fingerprints within a shard."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        n = len(fp)
        self.fp = fp
        _, first, self.shard_of = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first
        node = first[self.shard_of]  # where each item stands on its way down
        todo = np.flatnonzero(node != np.arange(n))
        parent, edge = [], []
        while len(todo):
            d = popcount(fp[todo] ^ fp[node[todo]])
            key = node[todo] * 65 + d
            uniq, at, inv = np.unique(key, return_index=True, return_inverse=True)
            child = todo[at]
            parent.append(uniq // 65)
            edge.append((child, uniq % 65))
            node[todo] = child[inv]
            todo = todo[child[inv] != todo]
        parents = np.concatenate(parent) if parent else np.zeros(0, np.int64)
        childs = np.concatenate([c for c, _ in edge]) if edge else np.zeros(0, np.int64)
        dists = np.concatenate([d for _, d in edge]) if edge else np.zeros(0, np.int64)
        order = np.argsort(parents * 65 + dists, kind="stable")
        #: children of all nodes, by (parent, edge number)
        self.keys, self.childs = (parents * 65 + dists)[order], childs[order]

    def neighbours(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i != j, of one shard within ``radius``, each both ways."""
        n = len(self.fp)
        stack = [(np.arange(a, min(n, a + FRONTIER)), self.root[self.shard_of[a:a + FRONTIER]])
                 for a in range(0, n, FRONTIER)]
        while stack:
            q, node = stack.pop()
            d = popcount(self.fp[q] ^ self.fp[node])
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right")
            size = hi - lo
            ends = np.cumsum(size)
            at = 0
            while at < len(q):  # cut so that one step holds about FRONTIER pairs
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FRONTIER, side="right")))
                s = size[at:upto]
                if s.sum():
                    pos = np.repeat(lo[at:upto] - (np.cumsum(s) - s), s) + np.arange(s.sum())
                    stack.append((np.repeat(q[at:upto], s), self.childs[pos]))
                at = upto


def stars(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the smallest one each is linked to within its shard,
    directly or over others; those alone are left out."""
    order = np.lexsort((fp, shard))
    shard, fp = shard[order], fp[order]
    label = np.arange(len(fp))
    for i, j in BKForest(shard, fp).neighbours(radius):
        while True:  # both ends of each pair to the smaller label
            a, b = label[i], label[j]
            low = np.minimum(a, b)
            if (a == b).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    tied = label != np.arange(len(fp))
    return fp[tied], fp[label[tied]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, shard_max: int = SHARD_MAX) -> DataFrame:
    """``(a, b)``: enough links between distinct fingerprints (``fp``) within
    ``max_bits`` to connect all that are connected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            a, b = stars(np.concatenate([x for x, _ in got]),
                         np.concatenate([x for _, x in got]).view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keys = shard_keys(fps, max_bits, shard_max).repartition("shard")
    return keys.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, label)``: the smallest node that each node of ``edges(a, b)``
    is connected with.  Each round takes the smallest label around and then the
    label's own label, on written tables; a group of diameter d needs about
    log d rounds."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        around = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = label.join(around, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("was"))
        hop = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = cut_lineage(step.join(hop, "label", "left").select(
            "node", F.least("label", "far").alias("label"), "was"), "labels")
        label = step.select("node", "label")
        if step.filter(F.col("label") != F.col("was")).isEmpty():
            return label
    raise RuntimeError(f"groups are still growing after {max_rounds} rounds")


def dedup(docs: DataFrame, shingle: int = WORDS, max_bits: int = MAX_BITS, doc: str = "doc_id",
          text: str = "text", shard_max: int = SHARD_MAX) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: fingerprint as 16 hex digits,
    component as the smallest document id of the group."""
    fps = cut_lineage(fingerprints(docs, shingle, doc, text), "simhash")
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    label = components(links(distinct.select("fp"), max_bits, shard_max))
    tagged = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp"))
    least = tagged.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = cut_lineage(tagged.select("fp", "label").join(least, "label").select("fp", "component_id"), "simhash-groups")
    return fps.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
