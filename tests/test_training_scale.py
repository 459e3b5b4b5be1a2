"""Training at size: rows of a task, the walk through the trees, fits of a cross-validation."""

import datetime as dt
import random

import numpy as np
import pytest

from txnrisk.operators.models import forest, train
from txnrisk.operators.models.estimators import ReconstructionEstimator
from txnrisk.operators.models.iforest import IsolationForestModel, grow_tree, path_lengths, walk_tables
from txnrisk.session import spread

ID = "transaction_id"
COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, *[rng.gauss(0, 1) + (4 if i % 20 == 0 else 0) for _ in COLS], int(i % 20 == 0)) for i in range(600)]
    return spark.createDataFrame(data, f"{ID} long, a double, b double, c double, label int").coalesce(1).persist()


def _sizes(df):
    return sorted(df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect())


def test_spread_bounds_partitions_and_keeps_rows(spark, rows):
    dealt = spread(rows, 20)
    assert max(_sizes(dealt)) <= 20 and sorted(dealt.collect()) == sorted(rows.collect())
    assert spread(rows, 600) is rows
    empty = rows.where("a is null")
    assert spread(empty, 20) is empty


def test_a_full_partition_is_dealt_out_before_the_forest_reads_it(rows, monkeypatch):
    """Rows of one partition (as a scan packs them) went to one task, whatever their number."""
    seen = []

    class Classifier:
        def __init__(self, **_):
            pass

        def fit(self, data):
            seen.append(_sizes(data))

    monkeypatch.setattr(forest, "RandomForestClassifier", Classifier)
    monkeypatch.setattr(forest, "ROWS_PER_TASK", 25, raising=False)
    forest.fit_forest(rows, COLS)
    assert sum(seen[0]) == 600 and max(seen[0]) <= 25


def test_walk_equals_the_trees_node_by_node():
    rng = np.random.RandomState(3)
    n, psi = 12, 32
    shape = (n, 2 * psi - 1)
    feature, left, right = np.full(shape, -1), np.zeros(shape, int), np.zeros(shape, int)
    threshold, leaf = np.zeros(shape), np.zeros(shape)
    for t in range(n):
        x = rng.normal(size=(1 if t == 0 else psi, 4))      # tree 0 is a leaf
        for i, node in enumerate(grow_tree(x, np.random.RandomState(t), 5)):
            feature[t, i], threshold[t, i], left[t, i], right[t, i], leaf[t, i] = node
    X = rng.normal(size=(200, 4))
    X[::9, 1], X[3], X[4], X[5, 2] = np.nan, np.inf, -np.inf, threshold[1, 0]

    def walk(x):
        total = 0.0
        for t in range(n):
            at = 0
            while feature[t, at] >= 0:
                at = left[t, at] if x[feature[t, at]] <= threshold[t, at] else right[t, at]
            total += leaf[t, at]
        return total

    tables = walk_tables(feature, threshold, left, right)
    assert path_lengths(X, *tables, leaf).tolist() == [walk(x) for x in X]
    assert path_lengths(X[:0], *tables, leaf).tolist() == []


def test_empty_table_scores(spark, rows):
    m = IsolationForestModel(COLS, 2, np.full((1, 3), -1), np.zeros((1, 3)), np.zeros((1, 3), int), np.zeros((1, 3), int), np.ones((1, 3)), 1)
    assert m.transform(rows.where("a is null")).count() == 0


def test_cross_validation_fits_each_model_once_a_fold(rows):
    fits = []

    class Counting(ReconstructionEstimator):
        def _fit(self, dataset):
            fits.append((dataset.count(), {r.fold for r in dataset.select("fold").distinct().collect()}))
            return super()._fit(dataset)

    cv = train.cross_validate(rows, COLS, models={"ae": (Counting(inputCols=COLS, k=1), "ae_proba", "ae_pred")}).collect()
    assert [n for n, _ in fits] == [480] * 5 and [{0, 1, 2, 3, 4} - f for _, f in fits] == [{f} for f in range(5)]
    assert sorted(r.fold for r in cv) == list(range(5)) and all(r.n == 120 and r.n_fraud == 6 for r in cv)


def test_cross_validation_deals_rows_once_and_writes_scores_of_one_model_at_a_time(rows, monkeypatch):
    """All folds' scores came from one job, whose every task held the fitted models of all folds."""
    written, dealt, cut, deal = [], [], train.cut_lineage, train.spread

    def kept(df, name="stage"):
        out = cut(df, name)
        if name == "cv-scores":
            written.append({r.model for r in out.select("model").distinct().collect()})
        return out

    monkeypatch.setattr(train, "cut_lineage", kept)
    monkeypatch.setattr(train, "spread", lambda df, n: dealt.append(n) or deal(df, n))
    models = {m: (ReconstructionEstimator(inputCols=COLS, k=k, prefix=m), f"{m}_proba", f"{m}_pred") for k, m in ((1, "p"), (2, "q"))}
    cv = {(r.model, r.fold): r.n for r in train.cross_validate(rows, COLS, models=models).collect()}
    assert sorted(map(sorted, written)) == sorted([f"{m}/{f}"] for m in models for f in range(5)) and len(dealt) == 1
    assert cv == {(m, f): 120 for m in models for f in range(5)}


def test_rows_are_dealt_in_whole_rounds_of_the_cores(spark, rows):
    cores = spark.sparkContext.defaultParallelism
    n = spread(rows, 600 // (cores + 1)).rdd.getNumPartitions()
    assert n > cores and n % cores == 0


def test_walk_tables_fill_the_trees_up():
    """Tree 0: a split with a leaf to its left and a split to its right; tree 1: a leaf."""
    feature, threshold = np.array([[1, -1, 0, -1, -1], [-1] * 5]), np.array([[0.5, 0, 2.0, 0, 0], [0.0] * 5])
    left, right = np.array([[1, 0, 3, 0, 0], [0] * 5]), np.array([[2, 0, 4, 0, 0], [0] * 5])
    features, thresholds, leaf = walk_tables(feature, threshold, left, right)
    assert features.tolist() == [[1, 0, 0], [0, 0, 0]] and thresholds.tolist() == [[0.5, 2.0, np.inf], [np.inf] * 3]
    assert leaf.tolist() == [[4, 3, 1, 1], [0] * 4]


def test_submitted_rounds_are_built_once(spark, monkeypatch, tmp_path):
    """Each round read and joined all events again."""
    from txnrisk.plans import catalog_detect as cd
    read, sent = [], []

    class Stub:
        inbox = None

        def __init__(self, *_, **__):
            pass

        def drain(self):
            pass

    monkeypatch.setattr(cd.det, "Detector", Stub)
    monkeypatch.setattr(cd.det, "submit_lines", lambda lines, _: (read.extend(lines.inputFiles()), sent.extend(r.line for r in lines.collect())))
    monkeypatch.setattr(cd, "_DRAINED", {})
    sf = str(tmp_path)
    day = dt.datetime(2024, 1, 1)
    events = [(i, day + dt.timedelta(hours=i), i % 9, "click", float(i), f'{{"k": {i % 100}}}') for i in range(400)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
         .write.parquet(f"{sf}/events.parquet")
    spark.createDataFrame([(i, float(i)) for i in range(7)], "c_custkey long, c_acctbal double").write.parquet(f"{sf}/customer.parquet")
    cd.drained(spark, sf)
    assert read and not any("events.parquet" in f for f in read)
    assert sorted(sent) == sorted(r.line for r in cd.submissions(spark, sf).select("line").collect())
