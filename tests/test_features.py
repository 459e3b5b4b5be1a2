"""Edge frames for the feature expressions (traps T1, T3, T4, T5, T6, T16)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from txnrisk.functions import features as fx


def test_amount_bins_right_closed(spark):
    rows = [(0.0,), (50.0,), (50.01,), (200.0,), (500.0,), (2000.0,), (2001.0,), (None,),
            (float("nan"),)]
    df = spark.createDataFrame(rows, "amount double")
    out = df.select(fx.amount_category(fx.nan_to_null("amount")).alias("c")).collect()
    assert [r.c for r in out] == [None, "very_low", "low", "low", "medium", "high", "very_high",
                                  None, None]


def test_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(10.0, 0.0, 0.0), (10.0, -10.0, 12000.0)],
                               "amount double, account_balance double, income double")
    r = df.select(fx.amount_to_income_ratio("amount", "income").alias("i"),
                  fx.amount_to_balance_ratio("amount", "account_balance").alias("b"),
                  fx.balance_impact("amount", "account_balance").alias("imp")).collect()
    assert r[0].i is None and r[0].b is None and r[0].imp == 10.0 / 10.0
    assert r[1].imp is None and math.isclose(r[1].i, 10.0 / 1000.0)


def test_weekday_monday_zero_and_hour_flags(spark):
    monday = dt.datetime(2024, 1, 1, 5, 0, 0)      # a Monday, 05:00
    sunday = dt.datetime(2024, 1, 7, 22, 0, 0)     # a Sunday, 22:00
    noon = dt.datetime(2024, 1, 3, 17, 59, 0)
    df = spark.createDataFrame([(monday,), (sunday,), (noon,)], "t timestamp_ntz")
    r = df.select(fx.day_of_week("t").alias("d"), fx.is_weekend("t").alias("we"),
                  fx.is_night("t").alias("n"), fx.is_business_hours("t").alias("b")).collect()
    assert [(x.d, x.we, x.n, x.b) for x in r] == [(0, 0, 1, 0), (6, 1, 1, 0), (2, 0, 0, 1)]


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(None,), (50.0,), (900.0,)], "x double")
    r = [x.c for x in df.select(fx.clamp("x", 100.0, 800.0).alias("c")).collect()]
    assert r == [None, 100.0, 800.0]


def test_single_transaction_customer(spark):
    df = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), 10.0),
                                (2, 2, dt.datetime(2024, 1, 1), 5.0),
                                (3, 2, dt.datetime(2024, 1, 2), 15.0)],
                               "transaction_id long, customer_id long, event_time timestamp_ntz, "
                               "amount double")
    out = {r.transaction_id: r for r in fx.derive_features(df).collect()}
    one = out[1]
    assert one.customer_transaction_count == 1 and one.customer_amount_std is None
    assert one.amount_deviation is None and one.is_amount_above_avg == 0
    assert out[3].is_amount_above_avg == 1
    assert math.isclose(out[3].amount_deviation, (15.0 - 10.0) / (math.sqrt(50.0) + 1))


def test_money_mean_is_tie_proof(spark):
    # 8 values whose mean sits exactly on a 6th-decimal tie
    vals = [1854.0302375 * 8 - 7 * 1000.0] + [1000.0] * 7
    df = spark.createDataFrame([(1, v) for v in vals], "k long, amount double")
    r = df.groupBy("k").agg(fx.money_avg("amount").alias("m")).first()
    assert r.m == 1854.0302375


def test_features_conditional_on_columns(spark):
    df = spark.createDataFrame([(1, 20.0)], "transaction_id long, amount double")
    cols = fx.derive_features(df).columns
    assert "log_amount" in cols and "hour" not in cols and "is_mobile_device" not in cols
    df2 = df.withColumn("location", F.lit("international"))
    assert fx.derive_features(df2).first().is_high_risk_location == 1


def test_parse_timestamp_and_padded_id(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", 42), ("not a time", 7)], "t string, n int")
    r = df.select(fx.parse_timestamp("t").alias("ts"), fx.padded_id("CUST_", "n", 6).alias("id")) \
          .collect()
    assert r[0].ts == dt.datetime(2024, 1, 2, 3, 4, 5) and r[1].ts is None
    assert [x.id for x in r] == ["CUST_000042", "CUST_000007"]


def test_at_time_of_day_and_shuffle(spark):
    from txnrisk.operators import dashboard
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 15, 30, 12))],
                               "transaction_id long, t timestamp_ntz")
    r = df.select(fx.at_time_of_day("t", 3, 15).alias("x")).first()
    assert r.x == dt.datetime(2024, 1, 2, 3, 15)
    ids = spark.range(20).withColumnRenamed("id", "transaction_id")
    a = [x.transaction_id for x in dashboard.shuffled(ids).collect()]
    b = [x.transaction_id for x in dashboard.shuffled(ids.repartition(5)).collect()]
    assert a == b and sorted(a) == list(range(20)) and a != list(range(20))
