import random

import corpus_pipeline as cp
from corpus import ODD, SF, clashing, frame
from pyspark.sql import functions as F

from txnrisk.llm import decontaminate, secret_scan, simhash_dedup
from txnrisk.session import cut_lineage


def stage(spark, name, docs):
    return cut_lineage(dict(cp.STAGES)[name](spark, cut_lineage(docs, "in"), SF), "out")


def test_run_on_given_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = cp.run(spark, SF)
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert 0 < len(kept) <= docs.count() and out.count() == len(kept)
    assert out.columns[:5] == docs.columns
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.matches(out, items).isEmpty()
    assert secret_scan.scan(out).filter(F.exists("spans", lambda s: s["kind"] < 3)).isEmpty()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    groups = {r.doc_id: r.component_id for r in simhash_dedup.dedup(docs).collect()}
    lost = [i for i in good if i not in kept and groups[i] == i]
    assert len(lost) < 0.2 * len(good)


def test_stages_take_odd_rows_and_other_columns(spark):
    docs = clashing(frame(spark, ODD + [(60, "token = 'abcdefghijklmnop' here"), (61, "AKIA" + "B" * 20)]))
    for name, _ in cp.STAGES:
        out = stage(spark, name, docs)
        if name == "mixture":
            assert out.count() == docs.count() and {"copies", "taken"} <= set(out.columns)
        else:
            assert out.columns == docs.columns
        assert stage(spark, name, docs.limit(0)).count() == 0
    near = stage(spark, "near_duplicates", docs)
    ids = [r.doc_id for r in near.collect()]
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 1
    clean = {r.doc_id: r for r in stage(spark, "secrets", docs).collect()}
    assert clean[60].text == "[SECRET]' here" and clean[60].n_chars == 14 and clean[61].text == "[SECRET]"
    assert clean[1].text is None and clean[9].text == ODD[-1][1]


def test_leaks_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = frame(spark, [(1, f"before {item} after"), (2, "something else"), (None, item)])
    assert {r.doc_id for r in stage(spark, "decontaminate", docs).collect()} >= {2}
    assert 1 not in {r.doc_id for r in stage(spark, "decontaminate", docs).collect()}


def test_rows_are_judged_where_ids_are_null_or_repeat(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = frame(spark, [(1, "a clean text"), (1, f"before {item} after"), (2, "something else"), (None, item), (None, "clean too")])
    left = {(r.doc_id, r.text) for r in stage(spark, "decontaminate", docs).collect()}
    assert left == {(1, "a clean text"), (2, "something else"), (None, "clean too")}
    given = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.text for r in stage(spark, "quality", given).collect()}
    gone = {r.text for r in given.collect()} - kept
    good, bad = min(kept), min(gone)
    more = frame(spark, [(None, bad), (None, good), (-7, bad), (-7, good)]).select(*given.columns)
    out = stage(spark, "quality", given.unionByName(more)).filter("doc_id IS NULL OR doc_id = -7").collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(-7, good), (0, good)]


def test_one_row_of_each_near_group_stays(spark):
    rng = random.Random(6)
    a, b, c, d, e, f = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(6))
    docs = frame(spark, [(7, a), (9, a), (7, b), (3, b), (8, c), (8, d), (None, e), (None, e), (None, f), (4, f)])
    left = sorted(((r.doc_id, r.text) for r in stage(spark, "near_duplicates", docs).collect()), key=repr)
    assert left == sorted([(7, a), (3, b), (8, c), (8, d), (None, e), (4, f)], key=repr)
