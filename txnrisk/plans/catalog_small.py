"""Catalogue, part 7: small column operators on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import features as fx
from txnrisk.functions import policies as pol
from txnrisk.plans.registry import query
from txnrisk.sources import fixtures
from txnrisk.sources.tables import read_table

ID = "transaction_id"
MODELS = ["p_amount", "p_location", "p_night"]


@query("parse_timestamps", sql="""
SELECT transaction_id, CASE WHEN transaction_id % 5 <> 0 THEN event_time END AS event_time FROM located""")
def parse_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Times as text, every fifth of them not a time."""
    e = read_table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return e.select(F.col("event_id").alias(ID), fx.parse_timestamp(text).alias("event_time"))


@query("times_of_day", sql="""
SELECT transaction_id, date_trunc('day', event_time) + to_hours(transaction_id % 24) + to_minutes(transaction_id % 60) AS at
FROM located""")
def times_of_day(spark: SparkSession, sf: str) -> DataFrame:
    t = fixtures.base_txn(spark, sf)
    return t.select(ID, fx.at_time_of_day("event_time", (F.col(ID) % 24).cast("int"), (F.col(ID) % 60).cast("int")).alias("at"))


@query("padded_ids", sql="""
SELECT transaction_id, 'CUST_' || lpad(CAST(customer_id AS VARCHAR), CAST(greatest(6, length(CAST(customer_id AS VARCHAR))) AS INTEGER), '0') AS cust
FROM located WHERE customer_id IS NOT NULL""")
def padded_ids(spark: SparkSession, sf: str) -> DataFrame:
    t = fixtures.base_txn(spark, sf).where(F.col("customer_id").isNotNull())
    return t.select(ID, fx.padded_id("CUST_", "customer_id", 6).alias("cust"))


@query("score_maps", sql="""
, m AS (SELECT *, (p_amount + p_location + p_night) / 3 AS m3 FROM scored)
SELECT transaction_id, round(m3 + 1e-9, 6) AS mean_score, round(CAST(1 AS DOUBLE) / (1 + ((p_amount - m3) * (p_amount - m3)
  + (p_location - m3) * (p_location - m3) + (p_night - m3) * (p_night - m3)) / 3) + 1e-9, 6) AS confidence FROM m""")
def score_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and agreement of scores that come as a map."""
    s = fixtures.scored(spark, sf).withColumn("m", pol.predictions_map(MODELS))
    return s.select(ID, F.round(pol.map_mean("m") + 1e-9, 6).alias("mean_score"),
                    F.round(pol.map_confidence("m") + 1e-9, 6).alias("confidence"))


@query("member_scores", sql="""
SELECT transaction_id, CASE WHEN transaction_id % 3 <> 0 THEN p_amount ELSE CAST(is_fraud AS DOUBLE) END AS score FROM scored""")
def member_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A member without a probability votes by its decision."""
    s = fixtures.scored(spark, sf)
    return s.select(ID, pol.member_score(F.when(F.col(ID) % 3 != 0, F.col("p_amount")), "is_fraud").alias("score"))
