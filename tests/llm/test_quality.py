import numpy as np
from corpus import ODD, clashing, documents, frame, rows
from pyspark.sql import functions as F

from txnrisk.llm import quality
from txnrisk.llm.queries import fold

GOOD, BAD = "The quiet river ran past the old mill, and nobody came.", "BUY!! NOW!! BUY!! CHEAP!! $$$ $$$ $$$"


def corpus(spark):
    learn = [(100 + i, (GOOD if i % 2 else BAD) + f" {i}") for i in range(400)]
    docs = frame(spark, learn + ODD + [(50, GOOD * 3000), (51, BAD * 3000)])
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(400)] + [(1, None), (7777, 1)], "doc_id long, quality int")
    return docs, labels


def test_given_labels_on_held_out_rows(spark):
    docs, sf = documents(spark).sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels, fold(5) == 0).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all((r.score >= 0.3) == bool(r.predicted) for r in got)


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    run = lambda d: rows(quality.classify(d, labels, F.coalesce(F.col("doc_id") < 100, F.lit(True))))
    out = run(docs)
    assert len(out) == docs.count() and out == run(clashing(docs))
    by = {r[0]: r for r in out}
    assert by[50][3] == 1 and by[51][3] == 0
    assert by[1][2] == by[2][2] and all(0 <= r[2] <= 1 for r in out)


def test_one_class_or_nothing(spark):
    docs, labels = corpus(spark)
    one = quality.classify(docs, labels.filter("quality = 1"), F.lit(False)).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.9
    none = quality.classify(docs, labels.limit(0), F.lit(False)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.limit(0), labels, F.lit(False)).collect() == []


def test_features_do_not_depend_on_blocks():
    texts = [GOOD, BAD, "", "Ha ha ha. ÉÀ été!!", GOOD * 5]
    data = [t.encode() for t in texts]
    off = np.append(0, np.cumsum([len(x) for x in data]))
    row, f = quality.features(np.frombuffer(b"".join(data), np.uint8), off)
    for i, x in enumerate(data):
        _, own = quality.features(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        assert f[row == i].tolist() == own.tolist()


def test_descent_separates():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 60)
    off, f = np.arange(0, 61 * 3, 3)[:61], np.concatenate([[10 + v, *rng.integers(100, 130, 2)] for v in y])
    w = quality.descend(off, f, y, np.ones(quality.BUCKETS))
    m = quality.margins(off, f, w, np.ones(quality.BUCKETS))
    assert ((m > 0) == (y > 0)).all()
