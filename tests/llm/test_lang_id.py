import numpy as np
from corpus import ODD, clashing, documents, frame, rows
from pyspark.sql import functions as F

from txnrisk.llm import lang_id
from txnrisk.llm.queries import fold

EN, FR = "the cat and the dog went to the house with her ", "le chat et la maison avec une belle fille dans les "


def test_held_out_accuracy(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in lang_id.identify(docs, fold(4) == 2).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i, r in got.items() if r.held_out]
    assert len(got) == len(truth) and held
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def two_languages(spark):
    learn = [(100 + i, (EN if i % 2 else FR) * (1 + i % 3)) for i in range(20)]
    df = frame(spark, learn + ODD + [(50, EN * 20000), (51, FR * 20000), (52, "12 34 !!")])
    return df.withColumn("lang", F.when(F.col("doc_id") >= 100, F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr")))


def test_odd_rows(spark):
    df = two_languages(spark)
    run = lambda d: rows(lang_id.identify(d, F.coalesce(F.col("doc_id") < 100, F.lit(True))))
    out = run(df)
    assert out == run(clashing(df)) and len(out) == df.count()
    by = {r[0]: r for r in out}
    assert [by[i][2] for i in (1, 2, 3, 52)] == ["und"] * 4 and by[1][3] == 0.0
    assert by[50][2] == "en" and by[51][2] == "fr" and by[50][3] > 0.9
    assert by[None][2] in ("en", "fr") and by[7][2] in ("en", "fr")


def test_nothing_or_one_language_to_learn(spark):
    df = frame(spark, [(1, EN), (2, None)])
    assert [r.lang_pred for r in lang_id.identify(df, F.lit(True)).collect()] == ["und", "und"]
    one = lang_id.identify(frame(spark, [(1, EN), (3, FR)]).withColumn("lang", F.lit("en")), F.lit(False))
    assert {r.lang_pred for r in one.collect()} == {"en"}
    assert lang_id.identify(frame(spark, []), F.lit(False)).collect() == []


def test_codewords_lie_apart():
    for k in (2, 3, 4, 5, 9, 30):
        code = lang_id.codewords(k)
        far = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert len(code) == k and min(far) >= (1 if k == 2 else 2)


def test_pieces_of_a_long_text_change_nothing(spark, monkeypatch):
    df = two_languages(spark).filter("doc_id >= 50")
    whole = rows(lang_id.identify(df, F.col("doc_id") < 100))
    monkeypatch.setattr(lang_id, "BLOCK", 1000)
    pieces = rows(lang_id.identify(df, F.col("doc_id") < 100))
    assert [r[:3] for r in whole] == [r[:3] for r in pieces]
    assert np.allclose([r[3] for r in whole], [r[3] for r in pieces])
