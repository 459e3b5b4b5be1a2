"""Model evaluation on a long table ``(model, label, score, pred)``.

Every metric is a ``groupBy(model)`` over that table, so many models cost one
pass.  Count-based metrics come from the confusion counts.  Ranking metrics
(ROC AUC, average precision, PR curve, best threshold) need cumulative counts
over scores in descending order; a global ``sum() over (order by score)``
would run in a single task, so ``ranked_curve`` uses a two-level prefix:

1. group rows to distinct ``(model, score)`` with positive/negative counts
   (partial aggregation on the map side);
2. cut the score range into quantile buckets (``approxQuantile`` on the
   distinct scores, at most ``MAX_BUCKETS`` numbers to the driver) and assign
   them with ``Bucketizer``;
3. per-bucket totals (``models x buckets`` rows, a bounded broadcast) give the
   counts above each bucket; a window inside each ``(model, bucket)`` gives the
   counts within.  Exact; no partition holds more than about
   ``rows / buckets`` distinct scores.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.operators.joins import sized
from txnrisk.session import cut_lineage

# --- fixed values (must equal the reference's) -------------------------------
COST_FP, COST_FN, COST_TP, COST_TN = 10, 1000, 50, 1
F1_EPS = 1e-8                      # best-threshold F1 denominator guard
# ------------------------------------------------------------------------------
MAX_BUCKETS = 8192
ROWS_PER_BUCKET = 100_000


def to_long(df: DataFrame, label: str, models: Sequence[str], threshold: float,
            keep: Sequence[str] = ()) -> DataFrame:
    """Wide scores -> ``(model, label, score, pred)`` in one scan."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("model_idx"),
                             F.col(m).cast("double").alias("score"))
                    for i, m in enumerate(models)])
    out = df.select(*keep, F.col(label).cast("int").alias("label"), F.inline(arr))
    return out.withColumn("pred", (F.col("score") >= threshold).cast("int"))


def _div(num: Column, den: Column) -> Column:
    """Metric ratio: 0 when the denominator is 0 (as the reference)."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def confusion(long: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    y, p = F.col("label") == 1, F.col("pred") == 1
    return long.groupBy(*group).agg(
        F.min("model_idx").alias("model_idx"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def _cm():
    return F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")


def basic_metrics(conf: DataFrame) -> DataFrame:
    tn, fp, fn, tp = _cm()
    n = tn + fp + fn + tp
    return conf.withColumns({
        "accuracy": _div(tp + tn, n), "precision": _div(tp, tp + fp),
        "recall": _div(tp, tp + fn), "f1_score": _div(2 * tp, 2 * tp + fp + fn)})


def rate_metrics(conf: DataFrame) -> DataFrame:
    tn, fp, fn, tp = _cm()
    return conf.withColumns({
        "true_positive_rate": _div(tp, tp + fn), "false_positive_rate": _div(fp, fp + tn),
        "true_negative_rate": _div(tn, fp + tn), "false_negative_rate": _div(fn, tp + fn),
        "false_discovery_rate": _div(fp, tp + fp), "false_omission_rate": _div(fn, tn + fn),
        "positive_predictive_value": _div(tp, tp + fp),
        "negative_predictive_value": _div(tn, tn + fn)})


def mcc(conf: DataFrame) -> DataFrame:
    """Matthews correlation; the four-count product is taken in doubles (it
    overflows 64-bit integers at about 5e4 per count)."""
    tn, fp, fn, tp = [x.cast("double") for x in _cm()]
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return conf.withColumn("matthews_corrcoef",
                           F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den))


def business_metrics(conf: DataFrame) -> DataFrame:
    tn, fp, fn, tp = _cm()
    total = fp * COST_FP + fn * COST_FN + tp * COST_TP + tn * COST_TN
    savings = fn * COST_FN          # the reference's name for missed-fraud value
    invest = tp * COST_TP
    return conf.withColumns({
        "total_cost": total,
        "cost_per_transaction": _div(total, tn + fp + fn + tp),
        "fraud_prevention_savings": savings,
        "customer_inconvenience_cost": fp * COST_FP,
        "investigation_cost": invest,
        "cost_reduction_percentage": _div(savings * 100, total),
        # NULL, not an error, when nothing was investigated
        "roi": F.when(savings > 0, F.try_divide((savings - invest).cast("double"), invest))
                .otherwise(F.lit(0.0)),
        "caught_fraud_value": tp * COST_FN})


def class_report(conf: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted
    averages (one row each)."""
    tn, fp, fn, tp = _cm()
    n = tn + fp + fn + tp
    p1, r1, f1 = _div(tp, tp + fp), _div(tp, tp + fn), _div(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _div(tn, tn + fn), _div(tn, tn + fp), _div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    none = F.lit(None).cast("double")

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("bigint").alias("support"))
    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", none, none, _div(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n),
            _div(f0 * s0 + f1 * s1, n), n))
    return conf.select("model", F.inline(rows))


def ranked_curve(long: DataFrame, group: Sequence[str] = ("model",),
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per group and distinct score (descending): ``pos``, ``neg`` at the
    score, cumulative ``tps``/``fps`` (scores >= this one) and group totals
    ``P``/``N``."""
    group = list(group)
    d = (long.where(F.col("score").isNotNull())
         .groupBy(*group, "score")
         .agg(F.sum("label").cast("bigint").alias("pos"),
              (F.count(F.lit(1)) - F.sum("label")).cast("bigint").alias("neg")))
    d = cut_lineage(d)   # reused below; reliable checkpoint in the shared folder
    n_distinct = d.count()
    n_buckets = max(1, min(MAX_BUCKETS, math.ceil(n_distinct / rows_per_bucket)))
    if n_buckets > 1:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        cuts = sorted(set(d.approxQuantile("score", probs, 1.0 / (4 * n_buckets))))
        d = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="score",
                       outputCol="_b").transform(d)
    else:
        d = d.withColumn("_b", F.lit(0.0))
    totals = d.groupBy(*group, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    above = (Window.partitionBy(*group).orderBy(F.col("_b").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy(*group)
    offsets = totals.select(
        *group, "_b",
        F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_on"),
        F.sum("_bp").over(whole).cast("bigint").alias("P"),
        F.sum("_bn").over(whole).cast("bigint").alias("N"))
    within = (Window.partitionBy(*group, "_b").orderBy(F.col("score").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    c = d.withColumns({"_lp": F.sum("pos").over(within), "_ln": F.sum("neg").over(within)})
    # offsets hold groups x buckets rows (models x <= MAX_BUCKETS): broadcast
    # after a size check, since the caller chooses the grouping
    c = c.join(sized(offsets, materialize=False), on=[*group, "_b"])
    return c.select(*group, "score", "pos", "neg",
                    (F.col("_op") + F.col("_lp")).cast("bigint").alias("tps"),
                    (F.col("_on") + F.col("_ln")).cast("bigint").alias("fps"), "P", "N")


def roc_auc(curve: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Mann-Whitney AUC with ties counted half; 0.0 when a class is missing."""
    contrib = F.col("pos") * ((F.col("N") - F.col("fps")) + 0.5 * F.col("neg"))
    pn = F.first("P").cast("double") * F.first("N")
    return curve.groupBy(*group).agg(
        F.when(pn > 0, F.sum(contrib) / pn).otherwise(F.lit(0.0)).alias("roc_auc"))


def average_precision(curve: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """sum over thresholds of (R_n - R_n-1) * P_n; 0.0 without positives."""
    prec = F.col("tps") / (F.col("tps") + F.col("fps"))
    return curve.groupBy(*group).agg(
        F.when(F.first("P") > 0, F.sum(F.col("pos") * prec) / F.first("P"))
        .otherwise(F.lit(0.0)).alias("pr_auc"))


def pr_curve(curve: DataFrame) -> DataFrame:
    recall = F.when(F.col("P") > 0, F.col("tps") / F.col("P")).otherwise(F.lit(1.0))
    return curve.select("model", F.col("score").alias("threshold"),
                        (F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"),
                        recall.alias("recall"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Threshold with the largest F1 (denominator + 1e-8); lowest wins ties."""
    pc = pr_curve(curve)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F1_EPS)
    pc = pc.withColumn("f1", f1)
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return pc.groupBy("model").agg(best.alias("b")).select("model", "b.threshold", "b.f1")


def cv_by_fold(long_with_fold: DataFrame) -> DataFrame:
    """AUC per (model, fold), with mean and population std over folds."""
    curve = ranked_curve(long_with_fold, group=("model", "fold"))
    per = roc_auc(curve, group=("model", "fold"))
    stats = per.groupBy("model").agg(F.avg("roc_auc").alias("cv_mean"),
                                     F.stddev_pop("roc_auc").alias("cv_std"))
    return per.join(stats, "model")


def best_models(comp: DataFrame, criteria: Sequence[str] = ("f1_score", "roc_auc", "roi")
                ) -> DataFrame:
    """Argmax model per criterion (first model wins ties) and the overall
    recommendation: the common winner, NULL when the criteria disagree."""
    aggs = [F.max_by("model", F.struct(F.col(c), -F.col("model_idx"))).alias(c)
            for c in criteria]
    wide = comp.agg(*aggs)
    same = F.col(criteria[0])
    for c in criteria[1:]:
        same = F.when(F.col(c) == F.col(criteria[0]), same)
    rows = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("model"))
                     for c in criteria],
                   F.struct(F.lit("recommended").alias("criterion"), same.alias("model")))
    return wide.select(F.inline(rows))


def rankings(comp: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Long ``(metric, model, value, rank)``: rank 1 = best, ties share a rank.
    The window runs over the comparison table (one row per model)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                      for m in metrics])
    long = comp.select("model", F.inline(pairs))
    w = Window.partitionBy("metric").orderBy(F.col("value").desc())
    return long.select("metric", "model", "value", F.rank().over(w).alias("rank"))
