"""The detectors as ML stages: in a Pipeline, saved and loaded, cross-validated by exact folds."""

import os
import random
import uuid

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from txnrisk.operators import dashboard, state
from txnrisk.operators.models import train
from txnrisk.operators.models.estimators import IsolationForestEstimator, IsolationForestModelStage, ReconstructionEstimator
from txnrisk.operators.models.iforest import IsolationForest
from txnrisk.operators.models.recon import NonlinearDetector
from txnrisk.operators.ranking import ranked
from txnrisk.session import checkpoint_dir

ID = "transaction_id"
COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, *[rng.gauss(0, 1) + (4 if i % 20 == 0 else 0) for _ in COLS], int(i % 20 == 0)) for i in range(600)]
    return spark.createDataFrame(data, f"{ID} long, a double, b double, c double, label int").repartition(3).persist()


def test_pipeline_of_detectors_saves_and_loads(spark, rows):
    stages = [IsolationForestEstimator(inputCols=COLS, numTrees=20, seed=7), ReconstructionEstimator(inputCols=COLS, k=1)]
    model = Pipeline(stages=stages).fit(rows)
    out = model.transform(rows).select(ID, "if_score", "if_pred", "ae_error", "ae_proba").orderBy(ID).collect()
    plain = IsolationForest(20, seed=7).fit(rows, COLS, ID).transform(rows).select("if_score").orderBy(ID).collect()
    assert [r.if_score for r in out] == [r.if_score for r in plain]
    path = os.path.join(checkpoint_dir(spark), f"stages-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    assert isinstance(back.stages[0], IsolationForestModelStage) and back.stages[0].getInputCols() == COLS
    assert back.transform(rows).select(ID, "if_score", "if_pred", "ae_error", "ae_proba").orderBy(ID).collect() == out


def test_estimator_itself_saves_and_loads(spark):
    path = os.path.join(checkpoint_dir(spark), f"estimator-{uuid.uuid4().hex}")
    IsolationForestEstimator(inputCols=COLS, numTrees=33, prefix="x").save(path)
    back = IsolationForestEstimator.load(path)
    assert back.getOrDefault(back.numTrees) == 33 and back.getPrefix() == "x" and back.getIdCol() == ID


def test_cross_validation_judges_each_row_once(spark, rows):
    models = {"if": (IsolationForestEstimator(inputCols=COLS, numTrees=20), "if_proba", "if_pred"),
              "ae": (ReconstructionEstimator(inputCols=COLS, k=1), "ae_proba", "ae_pred")}
    cv = train.cross_validate(rows, COLS, models=models).collect()
    assert sorted((r.model, r.fold) for r in cv) == [(m, f) for m in ("ae", "if") for f in range(5)]
    assert all(r.n == 120 and r.n_fraud == 6 and r.roc_auc > 0.8 for r in cv)


def test_nonlinear_reconstruction_ranks_outliers(rows):
    m = NonlinearDetector(k=2, units=16).fit(rows, COLS)
    out = m.transform(rows)
    assert set(out.columns) == {*rows.columns, "nl_error", "nl_pred", "nl_proba"}
    means = {r.label: r.e for r in out.groupBy("label").agg(F.avg("nl_error").alias("e")).collect()}
    assert means[1] > 2 * means[0]


@pytest.mark.parametrize("parts", [1, 7])
def test_exact_split_and_folds(spark, parts):
    df = spark.createDataFrame([(i, None if i % 50 == 0 else int(i % 7 == 0)) for i in range(503)], f"{ID} long, is_fraud int").repartition(parts)
    split, n = state.split_exact(df, ID), {r.is_fraud: r["count"] for r in df.groupBy("is_fraud").count().collect()}
    test = {r.is_fraud: r["count"] for r in split.where("is_test").groupBy("is_fraud").count().collect()}
    assert test == {k: int(0.2 * v + 0.5) for k, v in n.items()}
    folds = state.kfold_exact(df, ID)
    for by in ([], ["is_fraud"]):
        sizes = {}
        for r in folds.groupBy(*by, "fold").count().collect():
            sizes.setdefault(tuple(r[b] for b in by), []).append(r["count"])
        assert all(max(s) - min(s) <= 1 and len(s) == 5 for s in sizes.values())
    again = state.kfold_exact(df.repartition(3), ID)
    assert sorted(folds.select(ID, "fold").collect()) == sorted(again.select(ID, "fold").collect())


def test_places_within_groups(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", None, "x"]), rng.randrange(10), i) for i in range(400)]
    got = ranked(spark.createDataFrame(data, "g string, v int, i int").repartition(6), ["g"], ["v", "i"]).collect()
    for g in {d[0] for d in data}:
        want = sorted((v, i) for h, v, i in data if h == g)
        mine = sorted((r.place, r.v, r.i) for r in got if r.g == g)
        assert [(v, i) for _, v, i in mine] == want and [p for p, *_ in mine] == list(range(len(want)))
        assert {r.total for r in got if r.g == g} == {len(want)}
    assert ranked(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).collect() == []


def test_pages_equal_the_sorted_table(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([None, 0.1, 0.2, 0.5, 0.5]), rng.choice(["a", "b", None])) for i in range(57)]
    h = spark.createDataFrame(data, f"{ID} long, p double, s string").repartition(4)
    for col, k in (("p", 1), ("s", 2)):
        for descending in (False, True):
            want = sorted((d for d in data if d[k] is not None), key=lambda d: d[0])
            want = sorted(want, key=lambda d: d[k], reverse=descending) + sorted((d for d in data if d[k] is None))
            seen, after = [], None
            while True:
                page = dashboard.page(h, col, 10, after, descending).collect()
                if not page:
                    break
                seen += [r[ID] for r in page]
                after = (page[-1][col], page[-1][ID])
            assert seen == [d[0] for d in want]


def test_series_keeps_every_extreme(spark):
    import datetime as dt
    rng = random.Random(5)
    data = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(600)), round(rng.random(), 2), rng.random() < 0.3) for i in range(300)]
    h = spark.createDataFrame(data, f"{ID} long, timestamp timestamp_ntz, fraud_probability double, is_fraud boolean")
    points = {r[ID] for r in dashboard.series_points(h, "1 hour").collect()}
    assert len(points) <= 4 * 10 * 2
    for hour in range(10):
        for f in (False, True):
            own = [d for d in data if d[3] == f and (d[1] - dt.datetime(2024, 1, 1)).seconds // 3600 == hour]
            if own:
                assert any(d[0] in points and d[2] == max(x[2] for x in own) for d in own)
                assert any(d[0] in points and d[2] == min(x[2] for x in own) for d in own)
                assert any(d[0] in points and d[1] == max(x[1] for x in own) for d in own)
