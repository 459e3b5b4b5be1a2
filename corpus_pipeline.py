"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, mixture.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``
and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of ``documents`` (and
any others that came in).  ``run`` applies them to the table ``documents``.

What each stage decides:

* ``quality``: rows that the classifier scores below its threshold go.  It is
  learned from the labels of rows outside fold 0 among the stage's input.
* ``near_duplicates``: of each group of linked fingerprints one row stays, the
  smallest id (null last; of rows that repeat it, the smallest by a hash of the row).
* ``decontaminate``: rows that a benchmark item's tiles taint go.
* ``secrets``: every span found is replaced by ``[SECRET]`` and ``n_chars``
  follows; no row goes.
* ``mixture``: all rows stay and get ``size, source_size, target, rate, copies,
  taken``.

Defined cases: a null text counts as empty and stays null where nothing is
replaced; all stages judge row by row, also where ids are null or repeat, so
rows of one id with different texts don't share a fate; other columns are carried along, those that clash with the mixture's
names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import decontaminate, quality, secret_scan, simhash_dedup, source_mix
from txnrisk.llm.columns import once
from txnrisk.llm.queries import fold
from txnrisk.operators.joins import sized
from txnrisk.session import checkpoint_dir, cut_lineage
from txnrisk.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    held_out = fold(5) == 0
    model = quality.learn(rows, read_table(spark, sf_dir, "labels"), held_out)
    scored = quality.score(rows.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"),
                                       F.coalesce("text", F.lit("")).cast("binary").alias("t")), model)
    return _without(rows, scored.filter("predicted = 0"), key).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    groups = simhash_dedup.dedup(rows, doc=key)
    if key == "doc_id":
        return _without(rows, groups.filter("doc_id != component_id"), key)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                     F.xxhash64(*docs.columns).alias("hash"), F.col(key).alias("row"))
    members = cut_lineage(groups.select(F.col("doc_id").alias("row"), "component_id").join(
        rows.select(F.col(key).alias("row"), order.alias("order")), "row"), "near-members")
    stays = members.groupBy("component_id").agg(F.min("order").alias("first"), F.count("*").alias("n")).filter(
        "n > 1").select("component_id", F.col("first.row").alias("stays"))
    gone = members.join(sized(stays), "component_id").filter("row != stays").select(F.col("row").alias("doc_id"))
    return _without(rows, gone, key).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = _keyed(docs)
    tainted = decontaminate.matches(rows, read_table(spark, sf_dir, "benchmark"), doc=key)
    return _without(rows, tainted, key).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # spans beside the row's other columns, so that no join is needed
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    found = secret_scan.scan(packed.select(F.col("row").alias("doc_id"), F.col("row.text").alias("text")))
    found = once(found, clean=secret_scan.redact(F.col("text"), F.col("spans")))
    hit = F.size("spans") > 0
    return found.select(*[
        F.when(hit, F.col("clean")).otherwise(F.col("doc_id.text")).alias(c) if c == "text" else
        F.when(hit, F.length("clean").cast("long")).otherwise(F.col("doc_id.n_chars")).alias(c) if c == "n_chars" else
        F.col("doc_id")[c].alias(c) for c in docs.columns])


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    new = ["size", "source_size", "target", "rate", "copies", "taken"]
    docs = docs.drop(*new)
    rows, key = _keyed(docs)
    mixed = source_mix.mix(rows, doc=key, per="document").select(F.col("doc_id").alias(key), *new)
    return rows.join(sized(mixed), key).select(*docs.columns, *new)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the column that tells its rows apart: their ids, or where
    these repeat or are null a number given to the rows of a written table."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    key = "_row"
    while key in docs.columns:
        key = "_" + key
    return cut_lineage(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _without(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not a ``doc_id`` of ``found``."""
    return rows.join(sized(found.select(F.col("doc_id").alias(key)).distinct()), key, "left_anti")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secret_stage),
    ("mixture", mixture_stage),
]

#: SQL cannot express the classifier, XXH64 fingerprints or the tiling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    top = os.path.join(checkpoint_dir(spark), "pipeline", uuid.uuid4().hex)
    for name, stage in STAGES:
        path = os.path.join(top, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
