"""Small frames with the awkward rows that every operator must take."""

import os

SF = "/root/testdata/sf0.001"
#: (doc_id, text): null and empty texts, no words, ties, repeated rows, a null id
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "two words"), (5, "two words"), (6, "two words"),
       (None, "a row without an id"), (7, "a" * 5000), (8, "x " * 3000), (9, "Ünïcödé 日本語 text — and 😀 marks")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names operators use inside or for results
CLASH = ["size", "t", "row", "fp", "shard", "pos", "score", "spans", "target", "_n", "y", "v", "digest", "value", "label"]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en" if n % 2 else "fr", None if n % 5 == 0 else f"src{n % 3}", len(t or "")) for n, (i, t) in enumerate(rows)], SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_on_clash(run, df):
    """The rows of ``run(df)``, which other columns must not change."""
    out = rows(run(df))
    assert out == rows(run(clashing(df)))
    return out


def documents(spark):
    return spark.read.parquet(os.path.join(SF, "documents.parquet"))
