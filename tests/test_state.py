"""Fit/transform state: unseen categories, flat columns, imputation,
split/fold proportions, preprocessor persistence."""

import os
import uuid

from pyspark.sql import functions as F

from txnrisk.operators import state
from txnrisk.session import checkpoint_dir
from txnrisk.sources import fixtures

SF_SMALL = "/root/testdata/sf0.001"


def test_unseen_categories(spark):
    fit = spark.createDataFrame([("grocery", "web"), ("unknown", "pos"), ("gas", "atm")],
                                "merchant_category string, device_type string")
    vocab = state.fit_vocabulary(fit, ["merchant_category", "device_type"])
    codes = {(r.column_name, r.value): r.code for r in vocab.collect()}
    assert codes[("merchant_category", "unknown")] == 2      # gas 0, grocery 1, unknown 2
    new = spark.createDataFrame([("books", "watch"), ("gas", "web")],
                                "merchant_category string, device_type string")
    out = state.encode(new, vocab, ["merchant_category", "device_type"]).collect()
    assert (out[0].merchant_category_encoded, out[0].device_type_encoded) == (2, 3)
    assert (out[1].merchant_category_encoded, out[1].device_type_encoded) == (0, 2)


def test_null_category_is_text_nan(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    codes = {r.value: r.code for r in state.fit_vocabulary(df, ["c"]).collect()}
    assert codes == {"a": 0, "nan": 1, "z": 2}


def test_flat_column_scales_by_one_and_medians(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, None), (3.0, 5.0), (3.0, 2.0)],
                               "flat double, x double")
    med, sc = state.fit_median_and_scaler(df, ["flat", "x"])
    assert med == {"flat": 3.0, "x": 2.0}
    assert sc["flat"] == (3.0, 0.0)
    out = state.scale(state.impute(df, med), sc).collect()
    assert {r.flat for r in out} == {0.0}
    # imputed x = [1, 2, 5, 2]: mean 2.5, population std 1.5
    assert abs(sc["x"][0] - 2.5) < 1e-12 and abs(sc["x"][1] - 1.5) < 1e-12


def test_split_and_folds_proportions(spark):
    t = fixtures.txn(spark, SF_SMALL)
    s = state.kfold_assign(state.split_stratified(t, "transaction_id"), "transaction_id")
    r = s.agg(F.avg(F.col("is_test").cast("int")).alias("test"),
              F.countDistinct("fold").alias("folds")).first()
    assert 0.15 < r.test < 0.25 and r.folds == 5


def test_preprocessor_roundtrip(spark):
    t = fixtures.txn(spark, SF_SMALL)
    pre = state.Preprocessor.fit(t)
    assert len(pre.feature_columns) == 29
    path = os.path.join(checkpoint_dir(spark), f"pre-{uuid.uuid4().hex}")
    pre.save(path)
    back = state.Preprocessor.load(spark, path)
    a = pre.transform(t).orderBy("transaction_id").collect()
    b = back.transform(t).orderBy("transaction_id").collect()
    assert a == b
    assert back.feature_columns == pre.feature_columns


def test_feature_types(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 0, "c")],
                               "transaction_id long, amount double, location string, is_fraud int, "
                               "customer_id string")
    assert state.feature_types(df) == (["amount"], ["location"])
