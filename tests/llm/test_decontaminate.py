import random
import re

from corpus import ODD, documents, frame, same_on_clash

from txnrisk.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten eleven twelve"


def brute(doc, item, k=5):
    w, x = (re.findall(r"[^\W_]+", t.lower()) for t in (doc, item))
    used_w, used_x, total = set(), set(), 0
    while True:
        best = (0,)
        for i in range(len(w)):
            for j in range(len(x)):
                n = 0
                while (i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]
                       and i + n not in used_w and j + n not in used_x):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return total / len(x)
        n, i, j = best
        used_w.update(range(i, i + n))
        used_x.update(range(j, j + n))
        total += n


def found(spark, docs, items, **kw):
    t = spark.createDataFrame(items, "item_id long, text string")
    return same_on_clash(lambda d: decontaminate.matches(d, t, **kw).select("doc_id", "item_id", "coverage"), docs)


def test_moved_passages_and_thresholds(spark):
    docs = frame(spark, [(1, "Seven, eight NINE ten eleven twelve. Then: one two three four five six"), (2, "one two three four"),
                         (3, "x one two three four five x"), (4, ITEM + " " + ITEM), (5, "nothing here at all to see")])
    assert found(spark, docs, [(7, ITEM)]) == [(1, 7, 1.0), (4, 7, 1.0)]


def test_odd_rows_short_and_repeated_items(spark):
    docs = frame(spark, ODD + [(20, ITEM), (20, ITEM), (None, ITEM)])
    got = found(spark, docs, [(1, None), (2, ""), (3, "two words"), (4, ITEM), (None, ITEM)])
    assert len(got) == 6 and {g[0] for g in got} == {20, None} and {g[1] for g in got} == {4, None}


def test_empty_tables(spark):
    assert found(spark, frame(spark, []), [(1, ITEM)]) == []
    assert found(spark, frame(spark, [(1, ITEM)]), []) == []


def test_random_texts_match_brute_force_in_blocks_of_seeds(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs, items = [(i, text(60)) for i in range(25)], [(i, text(14)) for i in range(12)]
    want = sorted((d, i, brute(t, x)) for d, t in docs for i, x in items if brute(t, x) >= 0.5)
    got = found(spark, frame(spark, docs), items, seed_block=40)
    assert sorted(got) == want


def test_repeated_token_texts(spark):
    docs = frame(spark, [(1, "a " * 2000), (2, "b " * 2000)])
    assert found(spark, docs, [(1, "a " * 30)]) == [(1, 1, 1.0)]


def test_given_documents(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(documents(spark), items).collect()}
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    whole = {(d, i.item_id) for i in items.collect() for d, t in texts.items() if f" {norm(i.text)} " in f" {norm(t)} "}
    assert whole and whole <= got
