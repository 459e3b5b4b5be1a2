import random

import numpy as np
from corpus import ODD, frame, same_on_clash

from txnrisk.llm import suffix_dedup as sd


def brute(docs, n=50):
    docs = [(sd.NO_ID if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, t in sorted(docs):
        for p in range(len(t) - n + 1):
            first.setdefault(t[p:p + n], i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if first[t[p:p + n]] < i:
                gone[p:p + n] = b"\1" * n
        out.append((None if i == sd.NO_ID else i, len(t), bytes(c for c, g in zip(t, gone) if not g),
                    sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))))
    return sorted(out, key=repr)


def check(spark, docs):
    got = same_on_clash(lambda d: sd.dedup(d).selectExpr("doc_id", "n_bytes", "kept", "size(spans) AS n"), frame(spark, docs))
    assert [(a, b, bytes(c), d) for a, b, c, d in got] == brute(docs)


def test_odd_rows(spark):
    check(spark, ODD + [(None, "a row without an id"), (30, "b" * 49), (31, "b" * 49), (32, "b" * 50), (33, "b" * 51), (34, "b" * 120)])
    check(spark, [])
    check(spark, [(1, None)])


def test_random_texts_with_shared_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 9)))
    shared = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(word() for _ in range(20)) for _ in range(rng.randrange(1, 5))]
        t = "".join(parts)
        a = rng.randrange(len(t))
        docs.append((rng.randrange(40), t[a // 2:]))
    check(spark, docs)


def test_repeats_within_and_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    body = "".join(rng.choice("xyz ") for _ in range(9000))
    docs = [(2, body), (1, body[4000:4100] + "q" * 30 + body[4050:4150]), (3, "ab" * 500), (4, "ab" * 500), (5, body[8000:] + body[:3000])]
    check(spark, docs)
    monkeypatch.setattr(sd.tokens, "BLOCK", 500)
    pos = sorted({(int(lo + p)) for _, _, lo, hi in sd._pieces(np.array([0, len(body)]), 50)
                  for p in sd.anchors(np.frombuffer(body.encode()[lo:hi], np.uint8), np.array([0, hi - lo]))[0]})
    monkeypatch.undo()
    assert pos == sd.anchors(np.frombuffer(body.encode(), np.uint8), np.array([0, len(body)]))[0].tolist()


def test_every_string_holds_an_anchor():
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 100, 3000).astype(np.uint8)
    at, _ = sd.anchors(buf, np.array([0, 1000, 1040, 3000]))
    for a, z in ((0, 1000), (1040, 3000)):
        for p in range(a, z - 49):
            assert ((at >= p) & (at <= p + 26)).any()
    assert not ((at >= 1000) & (at < 1040)).any()


def test_family_levels_shrink_geometrically():
    rng, f, seen = np.random.default_rng(1), sd.Family(), {}
    for b in range(40):
        head, doc = rng.integers(0, 3000, 50).astype(np.uint32), rng.integers(0, 200, 50)
        f.add(head, doc)
        for h, d in zip(head.tolist(), doc.tolist()):
            seen.setdefault(h, set()).add(d)
        sizes = [len(x[0]) for x in f.levels]
        assert all(a >= 2 * z for a, z in zip(sizes, sizes[1:]))
    assert f.shared_heads().tolist() == sorted(h for h, d in seen.items() if len(d) > 1)


def test_no_head_fills_a_group(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef ") for _ in range(40))
    passage = word() * 2 + "é" + word() + "-" * 120
    docs = [(i, word() + (passage if i % 3 else "") + word()) for i in range(300)]
    docs += [(400, "a" * 3000), (401, "b" + "a" * 2500), (402, "ab" * 900 + passage[30:100]), (401, "ab" * 700), (None, passage)]
    held = []

    def watched(f):
        def run(packed, *args):
            kind, n = np.uint32 if f.__name__ == "shared_entries" else np.uint64, {}
            for r in packed.select("shard", "head").collect():
                for h in np.frombuffer(r.head, kind).tolist():
                    n[r.shard, h] = n.get((r.shard, h), 0) + 1
            held.append(max(n.values(), default=0))
            return f(packed, *args)
        return run

    monkeypatch.setattr(sd, "HOT_ENTRIES", 100, raising=False)
    for name in ("shared_entries", "matches"):
        monkeypatch.setattr(sd, name, watched(getattr(sd, name)))
    check(spark, docs)
    assert len(held) >= 2 and max(held) <= 100


def test_strings_cut_together_hash_alike():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 4, 5000).astype(np.uint8)
    for share in (0.001, 0.02, 0.5):
        start = np.flatnonzero(rng.random(len(buf) - 49) < share)
        near, place = sd._around(buf, start, 50)
        assert (sd.head_hashes(near, 50, 1)[place] == sd.head_hashes(buf, 50, 1)[start]).all()
    assert len(sd._around(buf, np.array([7, 8, 9, 4000]), 50)[0]) == 52 + 50
