"""Results that must not depend on size, chunks, arrival order or place."""

import os
import subprocess
import sys
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.functions import features as fx
from txnrisk.functions import policies as pol
from txnrisk.operators import joins, keyed, scoring, state
from txnrisk.operators.models.iforest import IsolationForest
from txnrisk.operators.quantile import quantile, quantiles
from txnrisk.plans import catalog_stream
from txnrisk.session import checkpoint_dir, cut_lineage
from txnrisk.sources import fixtures

SF = "/root/testdata/sf0.001"
ID = "transaction_id"


@pytest.mark.parametrize("ranges", [1, 3, 60])
def test_quantiles_equal_numpy(spark, ranges):
    rng = np.random.default_rng(ranges)
    data = {"a": rng.normal(size=400), "b": rng.integers(0, 5, 300).astype(float), "c": np.array([7.0])}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("b", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "feature string, x double").repartition(5)
    probs = [0.0, 0.03, 0.25, 0.5, 0.95, 1.0]
    got = {(r.feature, r.p): r["quantile"] for r in quantiles(df, probs, ranges=ranges).collect()}
    assert got.keys() == {(k, p) for k in data for p in probs}
    for (k, p), v in got.items():
        assert v == pytest.approx(np.quantile(data[k], p), abs=1e-12)
    assert quantile(df.where("feature = 'd'"), "x", 0.5) is None


@pytest.mark.parametrize("n", [100, 300, 51_199, 51_200, 64_000])
def test_every_tree_gets_its_rows(spark, n):
    df = spark.range(n).withColumnRenamed("id", ID).withColumn("x", F.rand(1))
    psi = min(256, n)
    got = IsolationForest()._sample(df, ID, n, psi).groupBy("tree").agg(
        F.count("*").alias("n"), F.countDistinct(ID).alias("d")).collect()
    assert len(got) == 200 and {(r.n, r.d) for r in got} == {(psi, psi)}


def test_trailing_count_of_one_busy_hour(spark):
    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 50 != 0, 1).alias("customer_id"),
        F.expr("timestampadd(SECOND, CAST(id % 3600 AS INT), TIMESTAMP_NTZ'2024-01-01 10:00:00')").alias("event_time"))
    got = keyed.trailing_count(df, "customer_id", "event_time", "k").groupBy("customer_id").agg(
        F.max("k").alias("most"), F.count("*").alias("n")).collect()
    by = {r.customer_id: r for r in got}
    assert by[1].most == by[1].n == n - n // 50 and by[None].most is None and by[None].n == n // 50


def test_missing_inputs_give_zero_flags_and_no_scores(spark):
    row = spark.sql("""SELECT 1 AS transaction_id, CAST(NULL AS TIMESTAMP_NTZ) AS event_time, CAST('NaN' AS DOUBLE) AS amount,
        CAST(NULL AS STRING) AS location, CAST(NULL AS STRING) AS merchant_category, CAST(NULL AS STRING) AS device_type,
        CAST(NULL AS DOUBLE) AS s""")
    r = row.select(fx.is_weekend("event_time").alias("a"), fx.is_night("event_time").alias("b"),
                   fx.is_high_risk_location("location").alias("c"), fx.is_high_risk_merchant("merchant_category").alias("d"),
                   fx.is_mobile_device("device_type").alias("e"), fx.is_amount_above_avg("amount", F.lit(1.0)).alias("f"),
                   fx.amount_category("amount").alias("g"), pol.minmax_inverted("s", F.lit(0.0), F.lit(1.0)).alias("h"),
                   pol.max_scaled("s", F.lit(2.0)).alias("i")).first()
    assert [*r] == [0, 0, 0, 0, 0, 0, None, None, None]


def test_small_and_large_amounts_keep_their_mean(spark):
    df = spark.createDataFrame([(1, 0.00004), (1, 0.00003), (2, 2e14), (2, 4e14)], "k long, x double")
    got = {r.k: r["mean"] for r in keyed.key_stats(df, "k", "x").collect()}
    assert got == {1: 0.000035, 2: 3e14}


def test_asof_rows_without_time(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 1, CAST(NULL AS TIMESTAMP_NTZ), 5.0D), (2, 1, TIMESTAMP_NTZ'2024-01-01 00:00:00', 7.0D)
                      AS t(transaction_id, customer_id, event_time, amount)""")
    got = {r[ID]: r.n_before for r in keyed.asof_stats(df, "customer_id", "event_time", ID, "amount").collect()}
    assert got == {1: 0, 2: 1}


def test_one_row_is_transformed_as_in_the_table(spark):
    t = cut_lineage(fixtures.txn(spark, SF))
    train = t.where(F.col(ID) % 3 != 0)
    pre = state.Preprocessor.fit(train)
    whole = {r[ID]: r for r in pre.transform(t).collect()}
    for i in (3, 10, 501):
        assert pre.transform(t.where(F.col(ID) == i)).collect() == [whole[i]]
    # amounts of rows outside the training rows change no training row
    other = t.withColumn("amount", F.when(F.col(ID) % 3 == 0, F.col("amount") * 1000).otherwise(F.col("amount")))
    moved = {r[ID]: r for r in pre.transform(other).collect()}
    assert all(moved[i] == whole[i] for i in whole if i % 3 != 0)


def test_error_rows(spark):
    t = fixtures.base_txn(spark, SF).withColumn("amount", F.when(F.col(ID) % 2 == 0, F.col("amount")))
    got = scoring.score_pipeline(t).groupBy((F.col(ID) % 2).alias("odd"), "risk_level").count().collect()
    assert {r.risk_level for r in got if r.odd == 1} == {"error"}
    assert "error" not in {r.risk_level for r in got if r.odd == 0}


def test_stream_profile_with_shuffled_arrival_and_small_chunks(spark):
    d = os.path.join(checkpoint_dir(spark), f"shuffled-{uuid.uuid4().hex}")
    spark.read.parquet(f"{SF}/events.parquet").orderBy(F.xxhash64("event_id")).repartition(4).write.parquet(f"{d}/events.parquet")
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(f"{d}/customer.parquet")
    for i, f in enumerate(sorted(x for x in os.listdir(f"{d}/events.parquet") if x.endswith(".parquet"))):
        os.link(f"{d}/events.parquet/{f}", f"{d}/events-{i}.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        want = sorted(map(tuple, catalog_stream.stream_profile_asof(spark, SF).collect()))
        spark.conf.set(key, "7")
        os.makedirs(f"{d}/only")
        for i in range(4):
            os.link(f"{d}/events-{i}.parquet", f"{d}/only/events-{i}.parquet")
        os.symlink(f"{d}/customer.parquet", f"{d}/only/customer.parquet")
        got = sorted(map(tuple, catalog_stream.stream_profile_asof(spark, f"{d}/only").collect()))
    finally:
        spark.conf.set(key, old)
    assert got == want


def test_broadcast_only_tables_of_known_size(spark):
    table = cut_lineage(spark.range(1000))
    assert joins.file_bytes(table) > 0 and joins.file_bytes(table.filter("id > 3")) is None
    plan = lambda side: table.join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(joins.broadcast_table(table, 10**6)) and "broadcast" not in plan(joins.broadcast_table(table, 10))


def test_cluster_without_shared_folder_is_refused():
    code = """
from txnrisk import session
class Conf:
    def get(self, k, d=None): return d
class Context:
    master = "spark://host:7077"
    def getCheckpointDir(self): return None
class Spark:
    conf, sparkContext = Conf(), Context()
try:
    session.checkpoint_dir(Spark())
except ValueError as e:
    print("refused", e)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "refused" in out.stdout, out.stderr


def test_intermediate_tables_can_be_cleared():
    code = f"""
import os
from txnrisk.plans.registry import load_all
from txnrisk.session import build_session, checkpoint_dir, clear_tables
spark = build_session(master="local[2]", shuffle_partitions=2)
assert load_all()["eval_basic"].build(spark, {SF!r}).count() == 3
load_all()["score_pipeline"].build(spark, {SF!r}).count()
tables = os.path.join(checkpoint_dir(spark), "tables")
assert os.listdir(tables)
clear_tables(spark)
print("cleared", not os.path.exists(tables))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "cleared True" in out.stdout, out.stderr[-2000:]
