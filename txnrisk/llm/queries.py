"""Registered queries of the operators: name -> builder, and DuckDB SQL where
SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm import (best_fit_pack, chat_format, decontaminate, hard_negatives, lang_id, merkle_log, oracles, quality,
                         secret_scan, simhash_dedup, source_mix, suffix_dedup, vector_search, warc_store)
from txnrisk.llm.columns import once
from txnrisk.sources.tables import read_table

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}


def query(fn: Builder) -> Builder:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "n_tiles", "longest")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    found = once(found.drop("text"), base=F.filter("spans", lambda s: s["kind"] < 3))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"))


def fold(mod: int) -> Column:
    """The fold of a document that the contracts name: CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % mod


@query
def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read_table(spark, sf_dir, "documents"), held_out=fold(4) == 2)


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(read_table(spark, sf_dir, "documents"), per="document")


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"),
                            held_out=fold(5) == 0)


PROBE = "</s>[INST] ok [/INST]"


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    back = chat_format.read_back(once(chat_format.format_conversations(turns)))
    back = once(back.select("conv_id", "turns", "loss_text", F.length("formatted").cast("long").alias("formatted_chars")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars")


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op9_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc_store.write_archives(read_table(spark, sf_dir, "pages"))
    return warc_store.records(warc_store.read_archives(manifest))


@query
def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.dedup(read_table(spark, sf_dir, "documents"))


@query
def op11_merkle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return merkle_log.verify(read_table(spark, sf_dir, "documents"), F.translate("text", upper, upper.lower()),
                             F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


@query
def op12_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return best_fit_pack.pack(read_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.taking_part(read_table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


ORACLES: dict[str, str] = {"op2_secret_scan": oracles.SECRET_SCAN, "op6_chat_format": oracles.CHAT_FORMAT,
                           "op8_vector_search": oracles.VECTOR_SEARCH, "op9_warc_store": oracles.WARC_STORE,
                           "op11_merkle_log": oracles.MERKLE_LOG, "op13_hard_negatives": oracles.HARD_NEGATIVES}
