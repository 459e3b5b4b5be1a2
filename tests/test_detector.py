"""The detector over submitted records: exactly one route a record, replays,
idle customers, live statistics, start and stop."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import keyed
from txnrisk.session import checkpoint_dir
from txnrisk.sources import fixtures
from txnrisk.streaming import detector as det

SF = "/root/testdata/sf0.001"
ID = det.ID
T0 = dt.datetime(2024, 1, 1, 12)
HOUR = dt.timedelta(hours=1)
SCHEMA = f"{ID} long, customer_id long, timestamp timestamp_ntz, amount double, merchant_category string, location string"


def detector(spark, **kw):
    path = os.path.join(checkpoint_dir(spark), f"detector-{uuid.uuid4().hex}")
    return det.Detector(spark, path, fixtures.customer_profile(spark, SF), **kw)


def record(i, customer=1, at=T0, amount=10.0):
    return (i, customer, at, amount, "gas", "local")


def send(spark, d, rows):
    det.submit(spark.createDataFrame(rows, SCHEMA), d.inbox)


def routes(d):
    return {(r[ID], r["route"]): r["n"] for r in d.table("routed").groupBy(ID, "route").agg(F.count("*").alias("n")).collect()}


def test_each_record_has_one_route(spark):
    d = detector(spark)
    send(spark, d, [record(1, at=T0 + 3 * HOUR), record(2, at=T0 + 2.5 * HOUR), record(2, at=T0 + 2.5 * HOUR), record(3, amount=None),
                    record(4, at=None), record(None)])
    det.submit_lines(spark.createDataFrame([('{"transaction_id": 5, "amou',), ('{"transaction_id": 6, "amount": "much"}',), ("",), ("[]",)], "l string"), d.inbox)
    d.drain()
    send(spark, d, [record(7, at=T0), record(1, at=T0 + 3 * HOUR), record(8, at=T0 + 2 * HOUR), record(4, at=None)])
    d.drain()
    got = routes(d)
    assert {k: n for k, n in got.items() if k[0] is not None and k[1] != "error"} == {
        (1, "scored"): 1, (2, "scored"): 1, (2, "duplicate"): 1, (4, "scored"): 1, (4, "duplicate"): 1, (7, "late"): 1, (1, "duplicate"): 1, (8, "scored"): 1}
    assert sum(got.values()) == 14
    assert (3, "error") in got
    st = d.statistics()
    assert st["total_transactions"] == sum(got.values()) and st["files_waiting"] == 0 and st["avg_processing_time"] > 0 and not st["is_running"]


def test_replayed_batch_writes_the_same(spark):
    d = detector(spark)
    send(spark, d, [record(i, customer=i % 3, at=T0 + i * HOUR / 10, amount=float(i)) for i in range(1, 30)])
    d.drain()
    send(spark, d, [record(i, customer=i % 3, at=T0 + i * HOUR / 10, amount=float(i)) for i in range(20, 50)])
    d.drain()
    kept = {"routed": ["batch_id", ID, "route"], "scored": ["batch_id", ID, "n_before", "fraud_probability", "risk_level"],
            "alerts": ["batch_id", ID], "progress": ["batch_id", "n_rows", *[f"n_{r}" for r in det.ROUTES], "watermark"]}
    read = lambda: {t: sorted(map(tuple, d.table(t).select(*c).collect())) for t, c in kept.items()}
    before, state = read(), d.state()
    batch = d.table("routed").where("batch_id = 1").select("line", "file", "arrival", *[f.name for f in det.FIELDS], F.lit(None).cast("string").alias("_corrupt"))
    d.process(spark.createDataFrame(batch.collect(), batch.schema).repartition(3), 1)       # as after a failure
    assert read() == before and {**d.state(), "millis": 0} == {**state, "millis": 0}
    assert len(before["routed"]) == 59 and len(before["scored"]) == 49


def test_idle_customers_keep_their_history(spark, monkeypatch):
    """As-of values equal the batch form's, however many batches a customer was away and profiles were merged."""
    monkeypatch.setattr(det, "COMPACT", 2)
    d = detector(spark, delay="1 minute")
    rng = random.Random(1)
    rows, i = [], 0
    for batch in range(6):
        new = []
        for c in (1, 2, 3):
            if c == 1 and 0 < batch < 5:
                continue                                     # away
            for k in range(4):
                i += 1
                new.append(record(i, c, T0 + batch * HOUR + i * HOUR / 1000, round(rng.uniform(1, 900), 2)))
        send(spark, d, new)
        d.drain()
        rows += new
    batch = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("timestamp", "event_time")
    want = {r[ID]: r for r in keyed.asof_stats(batch, "customer_id", "event_time", ID, "amount").collect()}
    got = {r[ID]: r for r in d.table("scored").collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k].n_before == w.n_before
        for f in ("avg_before", "std_before"):
            assert (got[k][f] is None) == (w[f] is None) and (w[f] is None or got[k][f] == pytest.approx(w[f], rel=1e-9))
    assert len(d.state()["profiles"]) <= 3 and len(d._names(d._path("profiles"))) <= 6


def test_one_second_trigger(spark):
    """Shuffled arrival under a running query: all records end in one route, late ones are behind what came before."""
    d = detector(spark, max_files=2)
    assert not d.submit(spark.createDataFrame([record(1)], SCHEMA))     # not running: refused
    d.start(interval="1 second")
    assert d.start() is d.query and d.running
    rng = random.Random(2)
    ids = list(range(1, 121))
    rng.shuffle(ids)
    for a in range(0, 120, 30):
        assert d.submit(spark.createDataFrame([record(i, i % 5, T0 + i * HOUR / 20) for i in ids[a:a + 30]], SCHEMA).repartition(2))
    d.stop()
    assert not d.running
    got = routes(d)
    assert sorted(i for i, _ in got) == sorted(ids) and set(got.values()) == {1}
    p = {r["batch_id"]: r for r in d.table("progress").collect()}
    for r in d.table("routed").select("batch_id", "route", F.unix_micros("event_ts").alias("t")).collect():
        w = p[r["batch_id"]]["watermark"]
        assert (r["route"] == "late") == (w is not None and r["t"] < w)
    totals = d.running_statistics().first()
    assert totals["total_transactions"] == 120 and totals["files_waiting"] == 0 and totals["batches"] == len(p) >= 2
    h = d.history()
    assert len(h.columns) == 10 and h.count() == sum(1 for _, r in got if r == "scored")
