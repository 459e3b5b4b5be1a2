import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from corpus import ODD, SF, clashing, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from txnrisk.llm import best_fit_pack as bp
from txnrisk.llm.queries import op12_best_fit_pack

FILE = path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def hold(got, data, size, end=0):
    """Pieces are those of the whole texts, sequences are gapless and not over ``size``."""
    want = []
    for doc, text in data:
        ids = plain_ids(text)
        first = len(ids) % size or min(len(ids), size)
        cuts = [0, *range(first, len(ids), size), len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size
    return len(bins), -(-sum(r[3] for r in got) // size)


def fewest(lengths, size):
    """Least number of bins, by trying all."""
    lengths = tuple(sorted(lengths, reverse=True))

    @lru_cache(None)
    def go(k, rooms):
        if k == len(lengths):
            return 0
        w = lengths[k]
        best = 1 + go(k + 1, tuple(sorted([*rooms, size - w])))
        for i, r in enumerate(rooms):
            if r >= w and (not i or rooms[i - 1] != r):
                best = min(best, go(k + 1, tuple(sorted([*rooms[:i], r - w, *rooms[i + 1:]]))))
        return best
    return go(0, ())


def count(lengths, size):
    return [sum(w == k for w in lengths) for k in range(size + 1)]


def kinds_hold(kinds, lengths, size):
    held = [0] * (size + 1)
    for n, room, parts in kinds:
        assert n > 0 and sum(w * t for w, t in parts) == size - room <= size
        for w, t in parts:
            held[w] += n * t
    assert held == count(lengths, size)


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 24).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=9))))
def test_reduction_keeps_the_optimum(case):
    size, lengths = case
    fixed, left = bp.reduce(count(lengths, size), size)
    rest = [w for w in range(size + 1) for _ in range(left[w])]
    assert sum(n for n, _, _ in fixed) + fewest(rest, size) == fewest(lengths, size)
    kinds_hold([*fixed, *bp.best_fit(left, size)], lengths, size)


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 60).flatmap(lambda size: st.tuples(st.just(size), st.lists(st.integers(1, size), max_size=200))))
def test_best_fit_equals_piece_by_piece(case):
    size, lengths = case
    rooms = []
    for w in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= w]
        r = min(fits) if fits else size
        if fits:
            rooms.remove(r)
        rooms.append(r - w)
    kinds = bp.best_fit(count(lengths, size), size)
    kinds_hold(kinds, lengths, size)
    assert sorted(r for n, r, _ in kinds for _ in range(n)) == sorted(rooms)


def test_plan_stays_small():
    rng = random.Random(5)
    one = [0] + [rng.randrange(1, 1000) for _ in range(bp.SIZE)]
    plan, larger = bp.plan(one, bp.SIZE), bp.plan([10**9 * c + rng.randrange(10**6) for c in one], bp.SIZE)
    assert len(plan["key"]) < 40_000 and len(larger["key"]) < 40_000


def test_words_are_those_of_whole_texts():
    words = bp.Words(FILE)
    blanks = [" ", "  ", "   ", "\n", "\n\n ", "\t", "\x0b", "\x1c", "\x85", "\xa0", "　 ", " ", "​", "﻿"]
    bits = ["word", "don't", "'s", "''s", "42", "x9", "é", "日本語", "😀", "!?", "!\x1c", ",'s", "word,", "a1", "²", "x²3", "ªb", "ſtɐ", "Ωm", "e\u0301", "(A)'T", "Don'tS", "__x", "_", "<|endoftext|>", "a" * 70, "-'ll"]
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(blanks if rng.random() < 0.5 else bits) for _ in range(rng.randrange(30)))
        assert [*np.frombuffer(words.ids(text), "<u4")] == plain_ids(text)[:-1], repr(text)


def test_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(bp, "BLOCK", 50)
    monkeypatch.setattr(bp, "CACHE", 20)
    rng = random.Random(7)
    text = "".join(rng.choice([" ", "  ", "\n", "ab", "longer", "é" * 80]) for _ in range(3000))
    assert [*np.frombuffer(bp.Words(FILE).ids(text), "<u4")] == plain_ids(text)[:-1]


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (19, [(0, 3), (3, 8), (11, 8)])])
def test_cuts(n, want):
    assert bp.cut(n, 8) == want


def test_odd_rows_and_clashing_columns(spark):
    df = frame(spark, ODD + [(10, "a b " * 40_000)]).repartition(3)
    for size in (16, 2048):
        got = rows(bp.pack(df, FILE, size))
        n, least = hold(got, [(r[0], r[1]) for r in df.collect()], size)
        assert n <= least + 1
        n_clash, _ = hold(rows(bp.pack(clashing(df), FILE, size)), [(r[0], r[1]) for r in df.collect()], size)
        assert n_clash == n
    assert rows(bp.pack(df.limit(0), FILE)) == []


def test_shuffled_counts(spark, monkeypatch):
    monkeypatch.setattr(bp, "BROADCAST_ROWS", 0)
    df = frame(spark, ODD).repartition(4)
    hold(rows(bp.pack(df, FILE, 8)), [(r[0], r[1]) for r in df.collect()], 8)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, least = hold(rows(op12_best_fit_pack(spark, SF)), [(r["doc_id"], r["text"]) for r in docs.collect()], bp.SIZE)
    assert n <= least + 2
