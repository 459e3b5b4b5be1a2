"""Merkle manifest of a dataset: a postorder append log of nodes by source.

Every row is a leaf; the leaves of a source, by id, are hashed ``ARITY`` at a
time, level upon level, to the source's subroot, and the subroots, by source,
likewise to the root.

Leaves and sources get their places by a range sort and prefix sums over the
partitions' counts.  Aligned builders then each take ``SPAN`` neighbouring
leaves and write the nodes above them in the order of their completion, which
is postorder; builders of the next tier take the topmost nodes of ``SPAN``
builders, and so on, one job a tier, until one node is left.  Where a node
stands in the log needs no pointers: the sizes of the subtrees before it say so
(``position``).  That is how proofs are read: siblings within a builder's part
by their places in it, those above by the place of their parent, whose entry
holds its run of children.

A builder's part is one row (32 bytes a node), nothing is held for a whole
source, and a hot source is many builders.

Defined cases: a null field hashes as ``-`` (so it differs from an empty one);
null sources are one source, the first; null ids come first; rows that repeat
an id are told apart by their leaf, equal rows stand next to each other; texts
are hashed whole by Spark; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.llm.columns import small_batches, written
from txnrisk.operators.joins import sized

ARITY = 16
#: levels that one builder adds, and the leaves (or nodes) it takes
SPAN_LEVELS = 2
SPAN = ARITY ** SPAN_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

PARTS = "t long, n long, chunk long, position long, nodes binary, ids array<long>, claims binary"
UPPER = "t long, n long, level int, i long, position long, digest binary, run binary"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_SMALL = 16 * 1024 * 1024  # digests don't compress: files are as large as the rows


# --- the tree's shape ---------------------------------------------------------------

def width(n: int, level: int) -> int:
    """Nodes on a level of a tree with ``n`` leaves."""
    return -(-n // ARITY ** level)


def height(n: int) -> int:
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def position(n: int, level: int, i: int) -> int:
    """Place of node ``i`` of ``level`` in the postorder log of ``n`` leaves: the
    nodes below it and all before them, its elder siblings, and what is complete above those."""
    end = min((i + 1) * ARITY ** level, n)
    below = sum(width(end, j) for j in range(level))
    above, j, top = 0, 1, height(n)
    while level + j <= top:
        above += i // ARITY ** j
        j += 1
    return below + i + above


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def completed(n: int, level: int, first: int, digests: list[str]) -> Iterator[tuple[int, int, str, list[str]]]:
    """``digests`` (neighbours on ``level`` from node ``first`` on) and the nodes
    above them in the order of completion: (level, i, digest, run of children)."""
    top = min(level + SPAN_LEVELS, height(n))
    open_runs: list[list[str]] = [[] for _ in range(top - level + 1)]
    for at, digest in enumerate(digests):
        up, i, last = level, first + at, at == len(digests) - 1
        yield up, i, digest, []
        open_runs[0].append(digest)
        while up < top and (last or (i + 1) % ARITY == 0):
            run, open_runs[up - level] = open_runs[up - level], []
            up, i, digest = up + 1, i // ARITY, _hash("".join(run))
            yield up, i, digest, run
            open_runs[up - level].append(digest)


# --- leaves -------------------------------------------------------------------------

def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a row of ``documents`` as 32 bytes; ``changed`` fields are read instead of the columns."""
    return F.unhex(F.sha2(F.concat(*[_field(changed.get(f, F.col(f))) for f in FIELDS]), 256))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``number``, their place in ascending ``order`` (nulls first): dealt by range, sorted
    in their partitions, and moved by the counts of those before (one row a partition)."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("part", F.spark_partition_id()).withColumn(
        "at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)
    counts = placed.groupBy("part").agg(F.count("*").alias("m"))
    before = counts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.col("at")).drop("part", "at", "before")


# --- building -----------------------------------------------------------------------

def _build_parts(t: pa.Table) -> pa.Table:
    """The log's part of one builder over leaves."""
    t = t.sort_by("i")
    n, first = t.column("n")[0].as_py(), t.column("i")[0].as_py()
    nodes = [node for _, _, node, _ in completed(n, 0, first, [x.hex() for x in t.column("leaf").to_pylist()])]
    return pa.table({
        "t": t.column("t").slice(0, 1), "n": [n], "chunk": t.column("chunk").slice(0, 1), "position": [position(n, 0, first)],
        "nodes": pa.array([bytes.fromhex("".join(nodes))], pa.binary()), "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())),
        "claims": pa.array([b"".join(t.column("claim").to_pylist())], pa.binary())})


def _build_upper(t: pa.Table) -> pa.Table:
    """Nodes that one builder of a higher tier completes."""
    t = t.sort_by("i")
    tree, n, level, first = (t.column(c)[0].as_py() for c in ("t", "n", "level", "i"))
    out = [(tree, n, up, i, position(n, up, i), bytes.fromhex(digest), bytes.fromhex("".join(run)))
           for up, i, digest, run in completed(n, level, first, [x.hex() for x in t.column("digest").to_pylist()]) if run]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    names = ["t", "n", "level", "i", "position", "digest", "run"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, types)], names=names)


@dataclass
class Log:
    """Nodes of a forest: ``parts`` of the builders over leaves, ``upper`` nodes, and ``tops(t, digest)``."""
    parts: DataFrame
    upper: DataFrame
    tops: DataFrame


def build(rows: DataFrame, largest: int) -> Log:
    """The log over ``rows(t, n, i, id, leaf, claim)``: leaf ``i`` of tree ``t``, which has ``n``.  ``claim``: the
    digest that a proof of the leaf is to be held against.  ``largest``: leaves of the largest tree."""
    spark = rows.sparkSession
    parts = written(rows.withColumn("chunk", F.expr(f"i DIV {SPAN}")).groupBy("t", "chunk").applyInArrow(_build_parts, PARTS), "merkle-parts")
    last = F.substring("nodes", -32, 32)
    tops = parts.filter(F.col("n") <= SPAN).select("t", last.alias("digest"))
    level, reach, upper = SPAN_LEVELS, SPAN, spark.createDataFrame([], UPPER)
    nodes = parts.filter(F.col("n") > SPAN).select("t", "n", F.lit(level).alias("level"), F.col("chunk").alias("i"), last.alias("digest"))
    while reach < largest:
        tier = written(nodes.groupBy("t", F.expr(f"i DIV {SPAN}")).applyInArrow(_build_upper, UPPER), "merkle-upper")
        upper = upper.union(tier)
        level, reach = level + SPAN_LEVELS, reach * SPAN
        # a tree's only node of a level is its top
        tops = tops.union(tier.filter(F.expr(f"i = 0 AND n <= power({ARITY}, level) AND n > power({ARITY}, level - 1)")).select("t", "digest"))
        nodes = tier.filter((F.col("level") == level) & (F.col("n") > reach)).select("t", "n", "level", "i", "digest")
    return Log(parts, upper, tops)


# --- proofs -------------------------------------------------------------------------

def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the runs stand that hold the ancestors of a builder's topmost node."""
    for b in batches:
        out = []
        for t, n, chunk in zip(*(b.column(c).to_pylist() for c in ("t", "n", "chunk"))):
            i = chunk
            for level in range(SPAN_LEVELS, height(n)):
                out.append((t, chunk, level, i % ARITY, position(n, level + 1, i // ARITY)))
                i //= ARITY
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, types)],
                              names=["t", "chunk", "level", "slot", "position"])


def climbs(log: Log) -> DataFrame:
    """``(t, chunk, up)``: runs above a builder's part, lowest first, with the slot of the way up in each."""
    wanted = log.parts.select("t", "n", "chunk").filter(F.col("n") > SPAN).mapInArrow(
        _parents, "t long, chunk long, level int, slot int, position long")
    runs = log.upper.select("t", "position", "run")
    return wanted.join(runs, ["t", "position"]).groupBy("t", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("level", "slot", "run"))).alias("up"))


def _runs(n: int, part: dict, at: int) -> Iterator[tuple[list[str], int]]:
    """Runs of a part that hold leaf ``at`` or an ancestor of it, with its slot."""
    i, levels = at, min(SPAN_LEVELS, height(n))
    for level in range(levels):
        first = i - i % ARITY
        key = (level, first)
        if key not in part["runs"]:
            stop = min(first + ARITY, width(part["end"], level))
            part["runs"][key] = [part["nodes"][position(n, level, j) - part["position"]] for j in range(first, stop)]
        yield part["runs"][key], i - first
        i //= ARITY


def _hexes(b: bytes) -> list[str]:
    s = b.hex()
    return [s[k:k + 64] for k in range(0, len(s), 64)]


def _leaves(row: dict) -> Iterator[tuple[int | None, str, str, list[tuple[list[str], int]]]]:
    """(id, leaf, claim, [(run, slot), ...] to the top) of each leaf of a part."""
    n, first = row["n"], row["chunk"] * SPAN
    claims = _hexes(row["claims"])
    part = {"position": row["position"], "nodes": _hexes(row["nodes"]), "end": first + len(claims), "runs": {}}
    up = [(_hexes(u["run"]), u["slot"]) for u in row["up"] or ()]
    for k, (i, claim) in enumerate(zip(row["ids"], claims)):
        yield i, part["nodes"][position(n, 0, first + k) - part["position"]], claim, [*_runs(n, part, first + k), *up]


def _tree_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ways from the subroots to the root, as ``(t, subroot, above)``."""
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.binary())]))
    for b in batches:
        for row in b.to_pylist():
            out = [(i, leaf_, [{"slot": s, "run": bytes.fromhex("".join(r))} for r, s in way]) for i, leaf_, _, way in _leaves(row)]
            t, sub, above = zip(*out)
            yield pa.record_batch([pa.array(t, pa.int64()), pa.array(sub, pa.string()), pa.array(above, kind)], names=["t", "subroot", "above"])


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of all leaves of the parts, and their claims folded along them."""
    for b in batches:
        for row in b.to_pylist():
            above = [(_hexes(u["run"]), u["slot"]) for u in row["above"]]
            out, joined = [], {}
            for i, leaf_, claim, way in _leaves(row):
                proof, digest = [], claim
                for run, slot in [*way, *above]:
                    key = (id(run), slot)
                    if key not in joined:
                        joined[key] = "".join(run[:slot]), "".join(run[slot + 1:])
                    left, right = joined[key]
                    proof += (left, right)
                    digest = _hash(left + digest + right)
                out.append((i, leaf_, row["subroot"], row["root"], _hash("".join(proof)), digest, digest == row["root"]))
            ids, *cols, ok = zip(*out)
            yield pa.record_batch([pa.array(ids, pa.int64()), *[pa.array(c, pa.string()) for c in cols], pa.array(ok, pa.bool_())],
                                  names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


@dataclass
class Manifest:
    """The log of all sources, the log over their subroots, and ``sources(source, first, n, t)``."""
    sources: DataFrame
    log: Log
    top: Log


def seal(rows: DataFrame) -> Manifest:
    """The manifest of ``rows(source, id, leaf, claim)``."""
    leaves = written(small_batches(rows).withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    places = numbered(leaves, ["source", "id", "leaf", "row"], "merkle-places")
    found = written(places.groupBy("source").agg(F.min("number").alias("first"), F.count("*").alias("n")), "merkle-counts")
    trees = written(numbered(found, ["source"], "merkle-sources").withColumnRenamed("number", "t"), "merkle-trees")
    n_trees, largest = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    side = sized(trees.withColumnRenamed("source", "of"), materialize=True, max_file_bytes=_SMALL)
    log = build(places.join(side, F.col("source").eqNullSafe(F.col("of"))).select(
        "t", "n", (F.col("number") - F.col("first")).alias("i"), "id", "leaf", "claim"), largest)
    subroots = log.tops.select(F.lit(0).cast("long").alias("t"), F.lit(n_trees).cast("long").alias("n"), F.col("t").alias("i"),
                               F.col("t").alias("id"), F.col("digest").alias("leaf"), F.col("digest").alias("claim"))
    top = build(subroots, n_trees)
    return Manifest(trees, log, top)


def prove(m: Manifest) -> DataFrame:
    """``PROOFS`` of every row that was sealed: ``folded_root`` is what its claim and its siblings lead to."""
    ways = m.top.parts.join(sized(climbs(m.top), max_file_bytes=_SMALL), ["t", "chunk"], "left").mapInArrow(
        _tree_paths, "t long, subroot string, above array<struct<slot:int,run:binary>>")
    root = m.top.tops.first()  # the only row, none of an empty table
    ways = sized(ways.withColumn("root", F.lit(root and root["digest"].hex())), max_file_bytes=_SMALL)
    parts = m.log.parts.join(sized(climbs(m.log), max_file_bytes=_SMALL), ["t", "chunk"], "left").join(ways, "t")
    return parts.mapInArrow(_prove, PROOFS)


def manifest(docs: DataFrame) -> Manifest:
    """The manifest of ``documents`` as they are."""
    return seal(docs.select("source", F.col("doc_id").cast("long").alias("id"), leaf().alias("leaf"), leaf().alias("claim")))


def verify(docs: DataFrame, claimed: Column, where: Column) -> DataFrame:
    """Seals ``docs`` and holds each row's proof against its leaf, with the text ``claimed`` instead of its own ``where`` that holds."""
    own = docs.select("source", F.col("doc_id").cast("long").alias("id"), leaf().alias("leaf"),
                      F.when(where, leaf(text=claimed)).alias("other"))
    return prove(seal(own.select("source", "id", "leaf", F.coalesce("other", "leaf").alias("claim"))))
