import random
import re

import numpy as np
import pytest
import xxhash
from corpus import ODD, documents, frame, same_on_clash

from txnrisk.llm import simhash_dedup as sh


def brute_fp(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, bits=3):
    fp = [brute_fp(t) for _, t in docs]
    label = [*range(len(docs))]
    for _ in docs:
        for i, a in enumerate(fp):
            for j, b in enumerate(fp):
                if (a ^ b).bit_count() <= bits:
                    label[i] = label[j] = min(label[i], label[j])
    least = {x: min((d for (d, _), y in zip(docs, label) if x == y and d is not None), default=None) for x in label}
    return sorted(((d, f"{f:016x}", least[x]) for (d, _), f, x in zip(docs, fp, label)), key=repr)


def test_odd_rows(spark):
    docs = ODD + [(40, "TWO Words"), (41, "two\x0bwords"), (42, "É é"), (43, "two words")]
    assert same_on_clash(sh.dedup, frame(spark, docs)) == brute(docs)
    assert sh.dedup(frame(spark, [])).collect() == []


def test_near_copies(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = []
    for i in range(12):
        base = [word() for _ in range(120)]
        for c in range(4):
            w = [*base]
            for _ in range(c):
                w[rng.randrange(len(w))] = word()
            docs.append((rng.randrange(1000), " ".join(w)))
    assert same_on_clash(sh.dedup, frame(spark, docs)) == brute(docs)


def test_crowded_blocks_are_cut_again(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(250)})
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    got = {}
    for most in (10_000, 20):
        label = sh.components(sh.links(df, shard_max=most))
        tag = {r.node: r.label for r in label.collect()}
        groups = {}
        for (x,) in df.collect():
            groups.setdefault(tag.get(x, x), set()).add(x)
        got[most] = sorted(map(sorted, groups.values()))
    assert got[10_000] == got[20]
    want = [{x} for x in fps]
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = (next(s for s in want if v in s) for v in (a, b))
                if x is not y:
                    x |= y
                    want.remove(y)
    assert sorted(len(s) for s in want) == sorted(map(len, got[20]))


@pytest.mark.parametrize("radius", [0, 1, 3, 10])
def test_forest_finds_all_neighbours(radius):
    rng = np.random.default_rng(radius)
    fp = np.unique(rng.integers(0, 1 << 16, 300, dtype=np.uint64))
    shard = np.sort(rng.integers(0, 4, len(fp)))
    pairs = {(int(i), int(j)) for a, b in sh.BKForest(shard, fp).neighbours(radius) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and shard[i] == shard[j]
            and int(fp[i] ^ fp[j]).bit_count() <= radius}
    assert pairs == want


def test_chains_become_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.label for r in sh.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert same_on_clash(sh.dedup, documents(spark)) == brute(docs)
