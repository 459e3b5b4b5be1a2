import math
import random
import struct

from corpus import clashing, rows
from pyspark.sql import functions as F

from txnrisk.llm import vector_search as vs

SCHEMA = "vec_id long, embedding array<float>"


def brute(data, every, k=5):
    v = {(i, tuple(max(-2**63, min(2**63 - 1, math.floor(256 * x))) for x in e)) for i, e in data
         if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q, a in {(i, x) for i, x in v if i % every == 0}:
        c = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in v if i != q and len(a) == len(b)))[:k]
        out += [(q, r + 1, i, max(-2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(c)]
    return sorted(out)


def check(spark, data, every=5, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    assert sorted(rows(vs.top_k(df, F.col("vec_id") % every == 0))) == brute(data, every)
    assert sorted(rows(vs.top_k(clashing(df), F.col("vec_id") % every == 0))) == brute(data, every)


def test_random_vectors(spark):
    rng = random.Random(1)
    f32 = lambda x: float(int(x * 4096)) / 4096  # noqa: E731  exact as float
    check(spark, [(i, [f32(rng.gauss(0, 1) * (1 + i % 3)) for _ in range(6)]) for i in range(700)])


def test_ties_copies_and_odd_rows(spark):
    same = [(i, [0.5, -0.25]) for i in range(300)]
    odd = [(1000, None), (1001, [1.0, None]), (1005, [float("nan"), 1.0]), (1010, [float("inf"), 0.0]), (None, [1.0, 1.0]),
           (1015, []), (1020, []), (1025, [1.0]), (1030, [0.0, 0.0]), (1035, [-2.0, 1.0]), (1035, [-2.0, 1.0])]
    check(spark, same + odd)
    check(spark, [])
    check(spark, [(0, [1.0])])


def test_many_shards_and_query_blocks(spark, monkeypatch):
    rng = random.Random(2)
    data = [(i, [rng.randrange(-8, 9) / 8 for _ in range(4)]) for i in range(400)]
    rows_ = vs.cut_lineage(vs.whole_vectors(spark.createDataFrame(data, SCHEMA)), "t")
    top = {4: float(max(sum(math.floor(256 * x) ** 2 for x in e) for _, e in data))}
    pages = vs.build(vs.distinct_vectors(rows_), top, page=8, shard_rows=60)
    assert pages.select("shard").distinct().count() > 3
    got = vs.search(pages, rows_.filter("vec_id % 5 = 0"), top, query_block=13)
    assert sorted(rows(got)) == brute(data, 5)


def test_negative_ids(spark):
    check(spark, [(i, [0.5, 0.25]) for i in (-5, -1, 0, 3)] + [(-2, [0.1, 0.1]), (-10, [1.0, -1.0])])


def test_large_scores_are_whole(spark):
    rng = random.Random(4)
    for top in (1e5, 1e9, 1e14, 1e25):
        check(spark, [(i - 30, [struct.unpack("f", struct.pack("f", rng.uniform(top / 2, top)))[0] for _ in range(16)]) for i in range(90)])
