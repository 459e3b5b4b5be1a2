import math
from collections import defaultdict

import pytest
from corpus import ODD, documents, frame, rows, same_on_clash
from pyspark.sql import functions as F

from txnrisk.llm import source_mix


def shares(sizes, weights=(5, 2, 1), total=1.5, cap=2.0):
    """Targets by repeated sharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = {}, total * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(full.values())
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if target[s] > cap * sizes[s]]
        if not over:
            return full | target
        full |= {s: cap * sizes[s] for s in over}


def test_targets_and_takes(spark):
    docs = documents(spark)
    out = source_mix.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
    want = shares(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    assert sum(abs(taken[s] - want[s]) for s in want) / sum(want.values()) < 0.03


def test_reruns_and_partitionings_agree(spark):
    docs = documents(spark)
    assert rows(source_mix.mix(docs)) == rows(source_mix.mix(docs.repartition(7)))


def test_odd_rows(spark):
    out = same_on_clash(source_mix.mix, frame(spark, ODD))
    assert len(out) == len(ODD)
    assert all(r[2] == 0 and r[7] == 0 for r in out if r[0] in (1, 2, 3))
    assert any(r[1] is None for r in out)
    assert source_mix.mix(frame(spark, [])).collect() == []
    assert [r.taken for r in source_mix.mix(frame(spark, [(1, None)])).collect()] == [0]


def test_prior_rates_are_tilted(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
                                   F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(0.5).alias("q"))
    out = source_mix.mix(docs, total_share=0.8, base_rate="q").collect()
    by = {r.doc_id: r for r in out}
    assert by[0].rate == pytest.approx(3 * by[1].rate)
    assert sum(r.rate * r["size"] for r in out) == pytest.approx(out[0].target, rel=1e-6)
    capped = source_mix.mix(docs, total_share=1.5, base_rate="q").collect()
    assert max(r.rate for r in capped) == 2.0
    assert sum(r.rate * r["size"] for r in capped) == pytest.approx(capped[0].target, rel=1e-6)


def test_rank_over_many_sources(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("source")).union(spark.sql("SELECT CAST(NULL AS STRING)"))
    got = [r.source for r in source_mix.source_ranks(df, "source").orderBy("rank").collect()]
    assert got == sorted(map(str, range(500))) + [None]


def dual(sizes, target, cap=2.0):
    """The tilt of one source, by halving: sum size * min(cap, exp(tilt * size / mean)) = target."""
    mean, lo, hi = sum(sizes) / len(sizes), -1e4, 1e4
    got = lambda x: sum(n * min(cap, math.exp(min(50, x * n / mean))) for n in sizes)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if got(mid) < target else (lo, mid)
    return (lo + hi) / 2 / mean


def test_rates_per_document_solve_the_dual(spark, monkeypatch):
    steps, cut = [], source_mix.cut_lineage
    monkeypatch.setattr(source_mix, "cut_lineage", lambda df, name: (steps.append(name), cut(df, name))[1])
    docs = documents(spark)
    out = source_mix.mix(docs, per="document").collect()
    assert steps.count("mix-dual") > 2                    # the start and more than one step
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    taken = 0.0
    for group in by.values():
        sizes, target = [r["size"] for r in group if r["size"]], group[0].target
        tilt = dual(sizes, target)
        full = target >= 2 * sum(sizes) * (1 - 1e-9)
        for r in group:
            want = 1.0 if not r["size"] else 2.0 if full else min(2.0, math.exp(tilt * r["size"]))
            assert r.rate == pytest.approx(want, rel=1e-5)
            assert r.taken <= 2 * r["size"]
        assert full or len({round(r.rate, 6) for r in group}) > 3
        taken += abs(sum(r.taken for r in group) - target)
    assert taken / sum(g[0].target for g in by.values()) < 0.03
    assert sorted(map(str, out)) == sorted(map(str, source_mix.mix(docs.repartition(5), per="document").collect()))


def test_odd_rows_per_document(spark):
    run = lambda d: source_mix.mix(d, per="document")
    out = same_on_clash(run, frame(spark, ODD + [(20, "w " * 300_000)]))
    assert len(out) == len(ODD) + 1 and all(r[2] == 0 and r[7] == 0 for r in out if r[0] in (1, 2, 3))
    assert run(frame(spark, [])).collect() == []
    assert [r.taken for r in run(frame(spark, [(1, None)])).collect()] == [0]


def test_unsettled_dual_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "MAX_STEPS", 1)
    with pytest.raises(RuntimeError):
        source_mix.mix(documents(spark), per="document")
