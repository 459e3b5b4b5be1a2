"""Persistence: train-all saves models, evaluation and report; reloaded
models give equal scores; sources: CSV, read-or-build, rows, reset."""

import os
import uuid

import pytest
from pyspark.sql import types as T

from txnrisk.operators.models import persist
from txnrisk.operators.models.train import Trained, train_all
from txnrisk.session import checkpoint_dir
from txnrisk.sources import files, fixtures

SF = "/root/testdata/sf0.001"
ID = "transaction_id"


def test_train_all_save_reload(spark):
    out = os.path.join(checkpoint_dir(spark), f"train-{uuid.uuid4().hex}")
    txn = fixtures.txn(spark, SF)
    trained, evaluation = train_all(spark, txn, out)
    assert {r.model for r in evaluation.collect()} == {"rf", "if", "ae", "ens"}
    assert spark.read.parquet(os.path.join(out, "evaluation")).count() == 4
    assert spark.read.text(os.path.join(out, "report")).count() > 10
    back = Trained.load(spark, os.path.join(out, "models"))
    cols = ["if_score", "ae_error", "rf_proba", "ens_proba"]
    a = trained.score(txn).select(ID, *cols).orderBy(ID).collect()
    b = back.score(txn).select(ID, *cols).orderBy(ID).collect()
    assert a == b


def test_missing_model_path_raises(spark):
    with pytest.raises(FileNotFoundError):
        persist.load_iforest(spark, os.path.join(checkpoint_dir(spark), "nope", "iforest"))


def test_sources_and_sinks(spark):
    base = os.path.join(checkpoint_dir(spark), f"src-{uuid.uuid4().hex}")
    schema = T.StructType([T.StructField(ID, T.LongType()), T.StructField("amount", T.DoubleType())])
    rows = files.rows(spark, [{ID: 1, "amount": 2.5}, {ID: 2}], schema)
    assert rows.collect()[1].amount is None
    files.save_tables({"transactions": rows, "customers": rows.select(ID)},
                      os.path.join(base, "data"))
    back = files.read_csv(spark, os.path.join(base, "data_transactions"), schema)
    assert sorted(back.collect()) == sorted(rows.collect())
    built = files.read_or_build(spark, os.path.join(base, "missing"), lambda: rows, schema)
    assert built.count() == 2
    files.write_table(rows, os.path.join(base, "hist"))
    files.reset_table(spark, os.path.join(base, "hist"), schema)
    assert spark.read.parquet(os.path.join(base, "hist")).count() == 0
