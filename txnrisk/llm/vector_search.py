"""Exact top-k by inner product: best-first search of paged M-trees.

Largest inner product becomes nearest point: with M the largest squared norm,
each vector x gets a further coordinate sqrt(M - |x|^2) and each query q a 0, and
then |q - x|^2 = |q|^2 + M - 2 q.x, a metric distance.  An M-tree is a tree of
pages; an entry of an inner page names a child page, its router, the covering
radius around it, and the router's distance to the page's own router.

Search keeps pages by their least possible distance and stops when that exceeds
the k-th best found.  Before it computes an entry's distance it takes the
triangle bound |d(q, page router) - d(entry, page router)| from stored
distances, and skips what cannot come near enough.  Bounds are loosened by a
relative ``SLACK`` against rounding; what they leave is scored in whole numbers,
in doubles only where no sum can reach 2^53, and ties go to the smaller id.

Spark's part: vectors go to ``shards`` by hash, and a tree per shard is written
as a table of pages; queries, in blocks of ``QUERY_BLOCK``, are searched in all
shards side by side, and each query's best of all shards are ranked.  Of equal
vectors only the ``k + 1`` smallest ids are indexed: no other can be among a
query's k best (one of them may be the query itself).

Defined cases: vectors that are null or hold a null, a NaN or an infinity take
no part, neither as queries nor as candidates; empty vectors are like any other
(score 0); vectors of a length other than the query's are not its candidates;
a query's own id is never its candidate; repeated rows of one id count once per
distinct vector, so that an id may be listed with two scores; components whose
``scale``-fold doesn't fit a long count as the nearest long, scores beyond a
long are ranked as they are and returned as the nearest one; queries without
candidates and empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.session import cut_lineage

K = 5
SCALE = 256
PAGE = 512
SHARD_ROWS = 4096
QUERY_BLOCK = 4096
SLACK = 1e-9
RESULT = "query_id long, vec_id long, score decimal(38,0)"
PAGES = ("dim int, shard long, page int, leaf boolean, ids array<array<long>>, vectors binary, further array<double>, "
         "to_router array<double>, radius array<double>, child array<int>")


def whole_vectors(vectors: DataFrame, scale: int = SCALE, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: floor(scale * x) of each component, of the vectors that take part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.filter(F.col(embedding).isNotNull() & ~bad).select(
        F.col(vec).cast("long").alias("vec_id"),
        F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)).alias("v")).filter(F.col("vec_id").isNotNull())


def distinct_vectors(rows: DataFrame, k: int = K) -> DataFrame:
    """``(v, ids)``: each distinct vector with its ``k + 1`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.distinct().withColumn("_n", place).filter(F.col("_n") <= k + 1).groupBy("v").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(col: pa.ListArray) -> np.ndarray:
    return np.array(col.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(col), -1)


class Tree:
    """M-tree pages of one shard.  Rows of ``x`` are points (with their further
    coordinate); entries of pages are rows, points of a leaf or routers."""

    def __init__(self, x: np.ndarray, page: int = PAGE):
        self.pages: list[dict] = []
        rng = np.random.default_rng(0)
        self.root, _ = self._grow(x, np.arange(len(x)), None, page, rng)

    def _grow(self, x: np.ndarray, rows: np.ndarray, router: np.ndarray | None, page: int, rng) -> tuple[int, float]:
        """Page over ``rows`` below ``router``; its number and covering radius."""
        if len(rows) <= page:
            return self._leaf(x, rows, router)
        parts = min(page, -(-2 * len(rows) // page))  # children about half full
        chosen = rng.choice(rows, parts, replace=False)
        centers = x[chosen]
        near = _distances(x[rows], centers).argmin(1)
        if (np.bincount(near, minlength=parts) == len(rows)).any():  # points alike: cut anywhere
            near = np.arange(len(rows)) * parts // len(rows)
        entries = []
        for c in range(parts):
            mine = rows[near == c]
            if len(mine):
                child, radius = self._grow(x, mine, centers[c], page, rng)
                entries.append((chosen[c], radius, child))
        routers = np.array([e[0] for e in entries])
        to = _distances(x[routers], router[None])[:, 0] if router is not None else np.zeros(len(routers))
        radius = np.array([e[1] for e in entries])
        self.pages.append({"leaf": False, "rows": routers, "to": to, "radius": radius,
                           "child": np.array([e[2] for e in entries], np.int32)})
        cover = float(_distances(x[rows], router[None]).max()) if router is not None else 0.0
        return len(self.pages) - 1, cover

    def _leaf(self, x: np.ndarray, rows: np.ndarray, router: np.ndarray | None) -> tuple[int, float]:
        to = _distances(x[rows], router[None])[:, 0] if router is not None else np.zeros(len(rows))
        self.pages.append({"leaf": True, "rows": rows, "to": to, "radius": np.zeros(len(rows)),
                           "child": np.zeros(0, np.int32)})
        return len(self.pages) - 1, float(to.max(initial=0.0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(d, 0.0))


def best_first(pages: dict[int, dict], root: int, whole: np.ndarray, own: int, k: int, m: float) -> list[tuple[int, int]]:
    """``(score, vec_id)`` of the k best candidates of one shard for the query ``whole``."""
    q = np.append(whole.astype(np.float64), 0.0)  # 0 for the further coordinate
    qq = float(q @ q)
    total = sum(abs(int(c)) for c in whole)
    slack = SLACK * (qq + m + 1.0)
    best: list[tuple[int, int]] = []  # heap of (score, -id): the worst is first

    def limit() -> float:
        """Distance beyond which nothing can matter; equal scores still can."""
        return np.inf if len(best) < k else np.sqrt(max(qq + m - 2.0 * best[0][0], 0.0) + slack) + np.sqrt(slack)

    heap = [(0.0, root, None)]
    while heap:
        least, number, d_router = heapq.heappop(heap)
        if least > limit():
            break
        p = pages[number]
        v, at = p["v"], None
        if d_router is not None:  # stored distances first
            may = np.abs(d_router - p["to"]) - p["radius"] <= limit()
            n = np.count_nonzero(may)
            if not n:
                continue
            if 4 * n < len(v):  # worth a copy of the few rows left
                at = np.flatnonzero(may)
                v = v[at]
        dot = v @ q  # the query's further coordinate is 0
        if p["leaf"]:
            rows = np.flatnonzero(dot >= best[0][0] - slack) if len(best) == k else np.arange(len(dot))
            here = rows if at is None else at[rows]
            if p["most"] * total < 2 ** 53:
                scores = dot[rows]
            else:
                kind = np.int64 if p["most"] * total < 2 ** 63 else object
                scores = p["whole"][here].astype(kind) @ whole.astype(kind)
            for s, row in zip(scores.tolist(), here.tolist()):
                for i in p["ids"][row]:
                    if i == own:
                        continue
                    item = (int(s), -i)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
        else:
            norms, radius, child = (p["norms"], p["radius"], p["child"]) if at is None else (
                p["norms"][at], p["radius"][at], p["child"][at])
            d = np.sqrt(np.maximum(qq + norms - 2.0 * dot, 0.0))
            low = np.maximum(d - radius, 0.0)
            for i in np.flatnonzero(low <= limit()).tolist():
                heapq.heappush(heap, (float(low[i]), int(child[i]), float(d[i])))
    return [(s, -i) for s, i in best]


def build(distinct: DataFrame, top: dict[int, float], page: int = PAGE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Table of pages (``PAGES``) of one tree per (vector length, shard).
    ``top``: the largest squared norm by vector length."""
    n = distinct.count()
    shards = max(1, -(-n // shard_rows))
    norms = distinct.sparkSession.sparkContext.broadcast(top)
    rows = distinct.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "v", "ids")

    def grow(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        whole = _matrix(t.column("v").chunk(0)) if dim else np.zeros((t.num_rows, 0), np.int64)
        x = whole.astype(np.float64)
        x = np.hstack([x, np.sqrt(np.maximum(norms.value[dim] - (x * x).sum(1), 0.0))[:, None]])
        ids = t.column("ids").to_pylist()
        tree = Tree(x, page)
        out = []
        for i, p in enumerate(tree.pages):
            out.append({"dim": dim, "shard": shard, "page": -1 - i if i == tree.root else i, "leaf": p["leaf"],
                        "ids": [ids[r] for r in p["rows"]] if p["leaf"] else [], "vectors": whole[p["rows"]].tobytes(),
                        "further": x[p["rows"], -1], "to_router": p["to"], "radius": p["radius"], "child": p["child"]})
        return pa.Table.from_pylist(out, schema=pa.schema([
            ("dim", pa.int32()), ("shard", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()),
            ("ids", pa.list_(pa.list_(pa.int64()))), ("vectors", pa.binary()), ("further", pa.list_(pa.float64())), ("to_router", pa.list_(pa.float64())), ("radius", pa.list_(pa.float64())),
            ("child", pa.list_(pa.int32()))]))

    return cut_lineage(rows.groupBy("dim", "shard").applyInArrow(grow, PAGES), "mtree")


def _load(t: pa.Table) -> tuple[dict[int, dict], int, int]:
    """Pages of one shard by number, and the root's number."""
    pages, root, dim = {}, 0, t.column("dim")[0].as_py()
    for r in t.to_pylist():
        number = r["page"] if r["page"] >= 0 else -1 - r["page"]
        root = number if r["page"] < 0 else root
        whole = np.frombuffer(r["vectors"], np.int64).reshape(len(r["further"]), dim)
        v = np.hstack([whole.astype(np.float64), np.array(r["further"], np.float64)[:, None]])
        pages[number] = {"leaf": r["leaf"], "ids": r["ids"], "v": v, "norms": (v * v).sum(1), "whole": whole,
                         "most": max(abs(int(whole.min(initial=0))), int(whole.max(initial=0))),
                         "to": np.array(r["to_router"]), "radius": np.array(r["radius"]), "child": np.array(r["child"], np.int32)}
    return pages, root, dim


def _searcher(shared, k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, vs, norms = shared.value
        tree, root, dim = _load(t)
        out = [(own, i, s) for own, v in zip(ids, vs) if len(v) == dim
               for s, i in best_first(tree, root, np.array(v, np.int64), own, k, norms[dim])]
        q, i, s = zip(*out) if out else ((), (), ())
        s = [Decimal(max(-10 ** 38 + 1, min(10 ** 38 - 1, x))) for x in s]
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()),
                         "score": pa.array(s, pa.decimal128(38, 0))})
    return run


def search(pages: DataFrame, queries: DataFrame, top: dict[int, float], k: int = K,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``.  ``queries(vec_id, v)``."""
    spark = pages.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // query_block))
    marked = cut_lineage(queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")), "mtree-queries")
    found = None
    for block in range(blocks):
        rows = marked.filter(F.col("block") == block).select("vec_id", "v").toArrow()  # about a block's rows
        shared = spark.sparkContext.broadcast(([*rows.column(0).to_pylist()], [*rows.column(1).to_pylist()], top))

        part = cut_lineage(pages.groupBy("dim", "shard").applyInArrow(_searcher(shared, k), RESULT), "mtree-found")
        shared.unpersist()
        found = part if found is None else found.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    bound = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    near = F.greatest(F.least("score", bound(2 ** 63 - 1)), bound(-2 ** 63)).cast("long")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", near.alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, vec: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """The k best candidates among all ``vectors`` of each row that ``is_query`` (a condition on ``vec_id``)."""
    rows = cut_lineage(whole_vectors(vectors, scale, vec, embedding), "mtree-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top = {r["d"]: r["m"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.max(square).alias("m")).collect()}
    pages = build(cut_lineage(distinct_vectors(rows, k), "mtree-distinct"), top)
    return search(pages, rows.filter(is_query).distinct(), top, k)
