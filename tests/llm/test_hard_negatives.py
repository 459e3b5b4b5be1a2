import math
import random

import numpy as np
import pytest
from corpus import clashing, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnrisk.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, every, positives=5, negatives=10):
    v = {(i, y, tuple(max(-2**63, min(2**63 - 1, math.floor(256 * x))) for x in e)) for i, e, y in data
         if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    near = lambda s: max(-2**63, min(2**63 - 1, s))
    out = []
    for a in v:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], c[2])), c[0], c[1]) for c in v if c[0] != a[0] and len(c[2]) == len(a[2])]
        for p, pid, _ in sorted(x for x in scored if x[2] == a[1])[:positives]:
            fits = sorted(x for x in scored if x[2] != a[1] and 30 * -p <= 100 * -x[0] <= 90 * -p)[:negatives]
            out += [(a[0], pid, r + 1, i, near(-p), near(-s)) for r, (s, i, _) in enumerate(fits)]
    return sorted(out)


def mined(df, every=5, **kw):
    return rows(hn.mine(hn.taking_part(df), F.col("id") % every == 0, **kw))


def check(spark, data, every=5, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    want = brute(data, every)
    assert sorted(mined(df, every, **kw)) == want
    assert sorted(mined(clashing(df), every, **kw)) == want
    return want


def vectors(rng, n, dim, labels=3):
    return [(i, [rng.randrange(-4096, 4096) / 4096 + (i % labels) * 0.2 for _ in range(dim)], i % labels) for i in range(n)]


def test_random_vectors_over_shards_and_blocks(spark):
    data = vectors(random.Random(1), 500, 6)
    assert len(check(spark, data, 25)) > 100
    check(spark, data, 25, shard_rows=40, anchor_block=5)


def test_ties_copies_and_odd_rows(spark):
    same = [(i, [0.5, 0.25], i % 2) for i in range(200)]
    odd = [(1000, None, 1), (1001, [1.0, None], 1), (1005, [float("nan"), 1.0], 0), (1010, [float("inf"), 0.0], 0), (None, [1.0, 1.0], 1),
           (1015, [], 0), (1020, [], 1), (1025, [], 0), (1030, [0.0, 0.0], 0), (1035, [-2.0, 1.0], 1), (1035, [-2.0, 1.0], 1),
           (1040, [1.0, 1.0], None), (-5, [0.4, 0.3], 1), (-10, [0.1, 0.1], 0), (1045, [0.3, 0.1], 0), (1045, [0.3, 0.2], 1)]
    assert check(spark, same + odd, shard_rows=50)
    check(spark, [])
    check(spark, [(0, [1.0], 1)])


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    for top in (1e6, 1e9, 1e14, 1e30):
        f32 = lambda x: float(np.float32(x))
        check(spark, [(i, [f32(rng.uniform(0, top)) for _ in range(8)], i % 2) for i in range(60)], 20)


def listed(data):
    import pyarrow as pa
    i, x, y = zip(*data)
    t = pa.table({"dim": pa.array([len(v) for v in x], pa.int32()), "shard": pa.array([0] * len(x), pa.int64()), "id": pa.array(i, pa.int64()),
                  "label": pa.array(y, pa.int64()), "v": pa.array(x, pa.list_(pa.int64()))})
    return hn.Lists(hn._lists(t).to_pylist()[0])


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3).flatmap(lambda dim: st.tuples(
    st.lists(st.tuples(st.integers(-9, 9), st.lists(st.integers(-4, 4), min_size=dim, max_size=dim)), min_size=1, max_size=60),
    st.lists(st.integers(-4, 4), min_size=dim, max_size=dim), st.lists(st.tuples(st.integers(-40, 40), st.integers(-40, 40)), max_size=3),
    st.integers(1, 4), st.integers(1, 8))))
def test_threshold_finds_what_a_full_scan_finds(case):
    data, a, windows, k, step = case
    lists = listed([(i, v, 0) for i, v in data])
    candidate = lists.ids % 3 != 0
    best, _ = hn.threshold(lists, np.array(a, np.int64), candidate, windows, k, step)
    for (low, high), (at, scores) in zip(windows, best):
        all_ = sorted((-int(lists.x[r] @ np.array(a)), int(lists.ids[r])) for r in np.flatnonzero(candidate)
                      if low <= int(lists.x[r] @ np.array(a)) <= high)
        assert [(-s, i) for i, s in hn._first(lists, at, scores, k)] == all_[:k]


def test_reading_stops_early():
    """One strong component: the best rows head its list, the rest is not scored."""
    lists = listed([(i, [1000 * i, i % 7], 0) for i in range(2000)])
    best, scored = hn.threshold(lists, np.array([5, 1]), np.ones(2000, bool), [(-math.inf, math.inf)], 5)
    assert sorted(lists.ids[best[0][0]].tolist()) == [1995, 1996, 1997, 1998, 1999]
    assert scored < 200


@pytest.mark.parametrize("score, want", [(100, (30, 90)), (7, (3, 6)), (0, (0, 0)), (-10, (-3, -9))])
def test_windows(score, want):
    assert hn._window(score, 30, 90) == want
