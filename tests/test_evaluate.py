"""Evaluation metrics: ties, one class, rate identities, and the two-level
ranked curve against a single-bucket run and brute force."""

import random

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txnrisk.operators import evaluate as ev


def _long(spark, labels, scores, model="m", threshold=0.6):
    df = spark.createDataFrame(list(zip(labels, scores)), "y int, s double")
    return ev.to_long(df, "y", ["s"], threshold).withColumn("model", F.lit(model))


def _auc_brute(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y == 0]
    if not pos or not neg:
        return 0.0
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(labels, scores):
    P = sum(labels)
    if P == 0:
        return 0.0
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for y, s in zip(labels, scores) if s >= t and y == 1)
        fp = sum(1 for y, s in zip(labels, scores) if s >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def test_ties_count_half(spark):
    long = _long(spark, [1, 0, 1], [0.5, 0.5, 0.5])
    curve = ev.ranked_curve(long)
    assert curve.count() == 1
    assert ev.roc_auc(curve).first().roc_auc == 0.5


def test_one_class_gives_zero(spark):
    long = _long(spark, [0, 0, 0], [0.1, 0.5, 0.9])
    curve = ev.ranked_curve(long)
    assert ev.roc_auc(curve).first().roc_auc == 0.0
    r = ev.rate_metrics(ev.confusion(long)).first()
    assert r.true_positive_rate == 0.0 and r.false_negative_rate == 0.0


def test_two_level_curve_matches_single_bucket_and_brute_force(spark):
    rng = random.Random(3)
    labels = [int(rng.random() < 0.3) for _ in range(600)]
    scores = [round(rng.random() ** 3, 3) for _ in labels]   # skewed, with ties
    long = _long(spark, labels, scores)
    one = ev.ranked_curve(long)                              # one bucket
    many = ev.ranked_curve(long, rows_per_bucket=7)          # ~ 60 buckets
    a1, a2 = ev.roc_auc(one).first().roc_auc, ev.roc_auc(many).first().roc_auc
    p1, p2 = (ev.average_precision(one).first().pr_auc,
              ev.average_precision(many).first().pr_auc)
    assert abs(a1 - a2) < 1e-12 and abs(p1 - p2) < 1e-12
    assert abs(a1 - _auc_brute(labels, scores)) < 1e-12
    assert abs(p1 - _ap_brute(labels, scores)) < 1e-12
    c1 = sorted((r.score, r.tps, r.fps) for r in one.collect())
    c2 = sorted((r.score, r.tps, r.fps) for r in many.collect())
    assert c1 == c2


@settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1000)), min_size=4, max_size=40))
def test_auc_invariant_under_monotone_rescaling(spark, pairs):
    # scores on a 1/1000 grid: squaring stays strictly monotone in floats
    labels = [p[0] for p in pairs]
    scores = [p[1] / 1000 for p in pairs]
    a = ev.roc_auc(ev.ranked_curve(_long(spark, labels, scores))).first().roc_auc
    b = ev.roc_auc(ev.ranked_curve(_long(spark, labels, [s * s for s in scores]))).first().roc_auc
    assert abs(a - b) < 1e-12
    assert abs(a - _auc_brute(labels, scores)) < 1e-12


def test_rates_pair_to_one_and_business(spark):
    labels = [1, 1, 0, 0, 0, 1]
    scores = [0.9, 0.2, 0.7, 0.1, 0.3, 0.65]
    conf = ev.confusion(_long(spark, labels, scores))
    r = ev.business_metrics(ev.mcc(ev.rate_metrics(conf))).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 1, 1, 2)
    assert abs(r.true_positive_rate + r.false_negative_rate - 1) < 1e-12
    assert abs(r.true_negative_rate + r.false_positive_rate - 1) < 1e-12
    assert r.total_cost == 1 * 10 + 1 * 1000 + 2 * 50 + 2 * 1
    assert r.roi == (1000 - 100) / 100


def test_roi_null_without_investigation(spark):
    conf = ev.confusion(_long(spark, [1, 0], [0.1, 0.2]))      # fn = 1, tp = 0
    assert ev.business_metrics(conf).first().roi is None


def test_best_threshold_lowest_wins_ties(spark):
    # thresholds 0.9 (p=1, r=.5) and 0.6 (p=.5, r=1) reach the same F1
    long = _long(spark, [1, 0, 0, 1], [0.9, 0.8, 0.7, 0.6])
    b = ev.best_threshold(ev.ranked_curve(long)).first()
    assert b.threshold == 0.6
