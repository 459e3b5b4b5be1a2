"""Catalogue, part 3: evaluation metrics over the stand-in ``scored`` view
(three models, decision threshold 0.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.operators import evaluate as ev
from txnrisk.operators import report, state
from txnrisk.operators.quantile import quantiles
from txnrisk.plans.registry import query
from txnrisk.session import cut_lineage
from txnrisk.sources import files, fixtures

MODELS = ["p_amount", "p_location", "p_night"]
THRESHOLD = 0.6


def _long(spark: SparkSession, sf: str, with_fold: bool = False) -> DataFrame:
    s = fixtures.scored(spark, sf)
    keep = []
    if with_fold:
        s = state.kfold_assign(s, "transaction_id")
        keep = ["fold"]
    return ev.to_long(s, "is_fraud", MODELS, THRESHOLD, keep=keep)


def _conf(spark, sf):
    return ev.confusion(_long(spark, sf))


def _r6(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep or dict(df.dtypes)[c] != "double"
                       else F.round(c, 6).alias(c) for c in df.columns])


# SQL -------------------------------------------------------------------------------

def sdiv(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE CAST(0 AS DOUBLE) END)"


SQL_LONG = """
, lng AS (
  SELECT 'p_amount' AS model, 0 AS model_idx, is_fraud AS label, p_amount AS score,
    CASE WHEN p_amount >= 0.6 THEN 1 ELSE 0 END AS pred, transaction_id FROM scored
  UNION ALL SELECT 'p_location', 1, is_fraud, p_location, CASE WHEN p_location >= 0.6 THEN 1 ELSE 0 END,
    transaction_id FROM scored
  UNION ALL SELECT 'p_night', 2, is_fraud, p_night, CASE WHEN p_night >= 0.6 THEN 1 ELSE 0 END,
    transaction_id FROM scored)
, cm AS (SELECT model, min(model_idx) AS model_idx,
    count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp
  FROM lng GROUP BY model)
"""
SQL_BASIC = f"""round({sdiv('tp + tn', 'tn + fp + fn + tp')}, 6) AS accuracy,
  round({sdiv('tp', 'tp + fp')}, 6) AS precision, round({sdiv('tp', 'tp + fn')}, 6) AS recall,
  round({sdiv('2 * tp', '2 * tp + fp + fn')}, 6) AS f1_score"""
SQL_RATES = f"""round({sdiv('tp', 'tp + fn')}, 6) AS true_positive_rate,
  round({sdiv('fp', 'fp + tn')}, 6) AS false_positive_rate,
  round({sdiv('tn', 'fp + tn')}, 6) AS true_negative_rate,
  round({sdiv('fn', 'tp + fn')}, 6) AS false_negative_rate,
  round({sdiv('fp', 'tp + fp')}, 6) AS false_discovery_rate,
  round({sdiv('fn', 'tn + fn')}, 6) AS false_omission_rate,
  round({sdiv('tp', 'tp + fp')}, 6) AS positive_predictive_value,
  round({sdiv('tn', 'tn + fn')}, 6) AS negative_predictive_value"""
SQL_MCC = """round(CASE WHEN sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN CAST(0 AS DOUBLE)
    ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)
      / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS matthews_corrcoef"""
SQL_BUSINESS = f"""fp * 10 + fn * 1000 + tp * 50 + tn * 1 AS total_cost,
  round({sdiv('fp * 10 + fn * 1000 + tp * 50 + tn * 1', 'tn + fp + fn + tp')}, 6) AS cost_per_transaction,
  fn * 1000 AS fraud_prevention_savings, fp * 10 AS customer_inconvenience_cost,
  tp * 50 AS investigation_cost,
  round({sdiv('fn * 1000 * 100', 'fp * 10 + fn * 1000 + tp * 50 + tn * 1')}, 6) AS cost_reduction_percentage,
  round(CASE WHEN fn * 1000 > 0 THEN CAST(fn * 1000 - tp * 50 AS DOUBLE) / NULLIF(tp * 50, 0)
    ELSE CAST(0 AS DOUBLE) END, 6) AS roi,
  tp * 1000 AS caught_fraud_value"""
SQL_CURVE = """
, dsc AS (SELECT model, score, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
  FROM lng WHERE score IS NOT NULL GROUP BY model, score)
, crv AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
    sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
    sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM dsc)
, auc AS (SELECT model, CASE WHEN max(P) * max(N) > 0
    THEN sum(pos * ((N - fps) + 0.5 * neg)) / (CAST(max(P) AS DOUBLE) * max(N)) ELSE CAST(0 AS DOUBLE) END AS roc_auc
  FROM crv GROUP BY model)
, ap AS (SELECT model, CASE WHEN max(P) > 0 THEN sum(pos * (CAST(tps AS DOUBLE) / (tps + fps))) / max(P)
    ELSE CAST(0 AS DOUBLE) END AS pr_auc FROM crv GROUP BY model)
, prc AS (SELECT model, score AS threshold, CAST(tps AS DOUBLE) / (tps + fps) AS precision,
    CASE WHEN P > 0 THEN CAST(tps AS DOUBLE) / P ELSE CAST(1 AS DOUBLE) END AS recall FROM crv)
, bt AS (SELECT model, arg_max(threshold, f1_key) AS threshold, max(f1) AS f1 FROM (
    SELECT *, 2 * precision * recall / (precision + recall + 1e-8) AS f1,
      struct_pack(a := 2 * precision * recall / (precision + recall + 1e-8), b := -threshold) AS f1_key
    FROM prc) GROUP BY model)
"""
SQL_FOLD = """CASE WHEN substr(md5(CAST(transaction_id AS VARCHAR)), 5, 4) < '3333' THEN 0
    WHEN substr(md5(CAST(transaction_id AS VARCHAR)), 5, 4) < '6666' THEN 1
    WHEN substr(md5(CAST(transaction_id AS VARCHAR)), 5, 4) < '9999' THEN 2
    WHEN substr(md5(CAST(transaction_id AS VARCHAR)), 5, 4) < 'cccc' THEN 3 ELSE 4 END"""
SQL_CV = """
, lf AS (SELECT *, """ + SQL_FOLD + """ AS fold FROM lng)
, dscf AS (SELECT model, fold, score, sum(label) AS pos, count(*) - sum(label) AS neg
  FROM lf GROUP BY model, fold, score)
, crvf AS (SELECT *, sum(neg) OVER (PARTITION BY model, fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
    sum(pos) OVER (PARTITION BY model, fold) AS P, sum(neg) OVER (PARTITION BY model, fold) AS N FROM dscf)
, aucf AS (SELECT model, fold, CASE WHEN max(P) * max(N) > 0
    THEN sum(pos * ((N - fps) + 0.5 * neg)) / (CAST(max(P) AS DOUBLE) * max(N)) ELSE CAST(0 AS DOUBLE) END AS roc_auc
  FROM crvf GROUP BY model, fold)
, cvs AS (SELECT model, avg(roc_auc) AS cv_mean, stddev_pop(roc_auc) AS cv_std FROM aucf GROUP BY model)
"""


# --- count metrics ------------------------------------------------------------------

@query("eval_confusion", sql=SQL_LONG + "SELECT model, tn, fp, fn, tp FROM cm")
def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return _conf(spark, sf).select("model", "tn", "fp", "fn", "tp")


@query("eval_basic", sql=SQL_LONG + f"SELECT model, {SQL_BASIC} FROM cm")
def eval_basic(spark: SparkSession, sf: str) -> DataFrame:
    b = ev.basic_metrics(_conf(spark, sf))
    return _r6(b.select("model", "accuracy", "precision", "recall", "f1_score"), ["model"])


RATE_COLS = ["true_positive_rate", "false_positive_rate", "true_negative_rate",
             "false_negative_rate", "false_discovery_rate", "false_omission_rate",
             "positive_predictive_value", "negative_predictive_value"]
BUSINESS_COLS = ["total_cost", "cost_per_transaction", "fraud_prevention_savings",
                 "customer_inconvenience_cost", "investigation_cost",
                 "cost_reduction_percentage", "roi", "caught_fraud_value"]


@query("eval_rates", sql=SQL_LONG + f"SELECT model, {SQL_RATES} FROM cm")
def eval_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(ev.rate_metrics(_conf(spark, sf)).select("model", *RATE_COLS), ["model"])


@query("eval_mcc", sql=SQL_LONG + f"SELECT model, {SQL_MCC} FROM cm")
def eval_mcc(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(ev.mcc(_conf(spark, sf)).select("model", "matthews_corrcoef"), ["model"])


@query("eval_business", sql=SQL_LONG + f"SELECT model, {SQL_BUSINESS} FROM cm")
def eval_business(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(ev.business_metrics(_conf(spark, sf)).select("model", *BUSINESS_COLS), ["model"])


@query("eval_class_report", sql=SQL_LONG + f"""
, pc AS (SELECT model, tn, fp, fn, tp, tn + fp + fn + tp AS n,
    {sdiv('tp', 'tp + fp')} AS p1, {sdiv('tp', 'tp + fn')} AS r1, {sdiv('2 * tp', '2 * tp + fp + fn')} AS f1,
    {sdiv('tn', 'tn + fn')} AS p0, {sdiv('tn', 'tn + fp')} AS r0, {sdiv('2 * tn', '2 * tn + fn + fp')} AS f0,
    tp + fn AS s1, tn + fp AS s0 FROM cm)
SELECT model, '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM pc
UNION ALL SELECT model, '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM pc
UNION ALL SELECT model, 'accuracy', NULL, NULL, round({sdiv('tp + tn', 'n')}, 6), n FROM pc
UNION ALL SELECT model, 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM pc
UNION ALL SELECT model, 'weighted avg', round({sdiv('p0 * s0 + p1 * s1', 'n')}, 6),
  round({sdiv('r0 * s0 + r1 * s1', 'n')}, 6), round({sdiv('f0 * s0 + f1 * s1', 'n')}, 6), n FROM pc""")
def eval_class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(ev.class_report(_conf(spark, sf)), ["model", "class"])


# --- ranking metrics ---------------------------------------------------------------------

def _curve(spark, sf):
    return ev.ranked_curve(_long(spark, sf))


@query("eval_roc_auc", sql=SQL_LONG + SQL_CURVE + "SELECT model, round(roc_auc, 6) AS roc_auc FROM auc")
def eval_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(ev.roc_auc(_curve(spark, sf)), ["model"])


@query("eval_pr_auc", sql=SQL_LONG + SQL_CURVE + "SELECT model, round(pr_auc, 6) AS pr_auc FROM ap")
def eval_pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(ev.average_precision(_curve(spark, sf)), ["model"])


@query("eval_pr_curve", sql=SQL_LONG + SQL_CURVE + """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM prc
WHERE model = 'p_amount'""")
def eval_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    s = fixtures.scored(spark, sf)
    long = ev.to_long(s, "is_fraud", ["p_amount"], THRESHOLD)
    pc = ev.pr_curve(ev.ranked_curve(long))
    return _r6(pc.select("threshold", "precision", "recall"), ["threshold"])


@query("eval_best_threshold", sql=SQL_LONG + SQL_CURVE + """
SELECT model, threshold, round(f1, 6) AS f1 FROM bt""")
def eval_best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(ev.best_threshold(_curve(spark, sf)), ["model", "threshold"])


@query("eval_cv_by_fold", sql=SQL_LONG + SQL_CV + """
SELECT a.model, a.fold, round(a.roc_auc, 6) AS roc_auc, round(c.cv_mean, 6) AS cv_mean,
  round(c.cv_std, 6) AS cv_std FROM aucf a JOIN cvs c ON a.model = c.model""")
def eval_cv_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    cv = ev.cv_by_fold(_long(spark, sf, with_fold=True))
    return _r6(cv.select("model", "fold", "roc_auc", "cv_mean", "cv_std"), ["model"])


# --- many models at once, comparison, recommendation ----------------------------------------

def all_models(spark: SparkSession, sf: str) -> DataFrame:
    # the base tables are read once; confusion, curves and folds come from this table
    long = cut_lineage(_long(spark, sf, with_fold=True), "eval-long")
    conf = ev.confusion(long)
    wide = ev.business_metrics(ev.mcc(ev.rate_metrics(ev.basic_metrics(conf))))
    curve = cut_lineage(ev.ranked_curve(long), "eval-curve")     # areas and threshold read it
    cv = ev.cv_by_fold(long).groupBy("model").agg(F.first("cv_mean").alias("cv_mean"),
                                                  F.first("cv_std").alias("cv_std"))
    # every table below has one row per model: tiny joins
    return (wide.join(ev.roc_auc(curve), "model").join(ev.average_precision(curve), "model")
            .join(ev.best_threshold(curve).withColumnRenamed("threshold", "optimal_threshold")
                  .withColumnRenamed("f1", "optimal_f1"), "model")
            .join(cv, "model"))


ALL_COLS = (["model", "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1_score"]
            + RATE_COLS + ["matthews_corrcoef"] + BUSINESS_COLS
            + ["roc_auc", "pr_auc", "optimal_threshold", "optimal_f1", "cv_mean", "cv_std"])


@query("eval_all_models", sql=SQL_LONG + SQL_CURVE + SQL_CV + f"""
SELECT cm.model, tn, fp, fn, tp, {SQL_BASIC}, {SQL_RATES}, {SQL_MCC}, {SQL_BUSINESS},
  round(auc.roc_auc, 6) AS roc_auc, round(ap.pr_auc, 6) AS pr_auc, bt.threshold AS optimal_threshold,
  round(bt.f1, 6) AS optimal_f1, round(cvs.cv_mean, 6) AS cv_mean, round(cvs.cv_std, 6) AS cv_std
FROM cm JOIN auc ON cm.model = auc.model JOIN ap ON cm.model = ap.model JOIN bt ON cm.model = bt.model
JOIN cvs ON cm.model = cvs.model""")
def eval_all_models(spark: SparkSession, sf: str) -> DataFrame:
    return _r6(all_models(spark, sf).select(*ALL_COLS), ["model", "optimal_threshold"])


COMPARISON_COLS = ["model", "accuracy", "precision", "recall", "f1_score", "roc_auc",
                   "total_cost", "roi", "cv_mean"]
SQL_COMPARISON = SQL_LONG + SQL_CURVE + SQL_CV + f"""
, cmp AS (SELECT cm.model, cm.model_idx, {SQL_BASIC}, round(auc.roc_auc, 6) AS roc_auc,
    fp * 10 + fn * 1000 + tp * 50 + tn * 1 AS total_cost,
    round(CASE WHEN fn * 1000 > 0 THEN CAST(fn * 1000 - tp * 50 AS DOUBLE) / NULLIF(tp * 50, 0)
      ELSE CAST(0 AS DOUBLE) END, 6) AS roi, round(cvs.cv_mean, 6) AS cv_mean
  FROM cm JOIN auc ON cm.model = auc.model JOIN cvs ON cm.model = cvs.model)
"""


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    a = all_models(spark, sf)
    return _r6(a.select(*COMPARISON_COLS, "model_idx"), ["model"])


@query("eval_comparison", sql=SQL_COMPARISON + f"SELECT {', '.join(COMPARISON_COLS)} FROM cmp")
def eval_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return comparison(spark, sf).select(*COMPARISON_COLS)


@query("eval_best_model", sql=SQL_COMPARISON + """
, best AS (SELECT arg_max(model, struct_pack(a := f1_score, b := -model_idx)) AS f1_score,
    arg_max(model, struct_pack(a := roc_auc, b := -model_idx)) AS roc_auc,
    arg_max(model, struct_pack(a := roi, b := -model_idx)) FILTER (WHERE roi IS NOT NULL) AS roi FROM cmp)
SELECT 'f1_score' AS criterion, f1_score AS model FROM best
UNION ALL SELECT 'roc_auc', roc_auc FROM best
UNION ALL SELECT 'roi', roi FROM best
UNION ALL SELECT 'recommended', CASE WHEN f1_score = roc_auc AND roi = f1_score THEN f1_score END FROM best""")
def eval_best_model(spark: SparkSession, sf: str) -> DataFrame:
    return ev.best_models(comparison(spark, sf))


@query("agg_score_threshold", sql="""
SELECT round(quantile_cont(p_amount, 0.03), 6) AS q03, round(quantile_cont(p_amount, 0.95), 6) AS q95
FROM scored""")
def agg_score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    s = fixtures.scored(spark, sf).select(F.lit("p_amount").alias("feature"), F.col("p_amount").alias("x"))
    q = quantiles(s, [0.03, 0.95])
    return q.agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("quantile"))), 6).alias(name)
                   for name, p in (("q03", 0.03), ("q95", 0.95))])


RANKED_METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]


@query("eval_rankings", sql=SQL_COMPARISON + "\n  UNION ALL ".join(
    f"SELECT '{m}' AS metric, model, {m} AS value, "
    f"CAST(rank() OVER (ORDER BY {m} DESC) AS INTEGER) AS rank FROM cmp" for m in RANKED_METRICS))
def eval_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """Chart data: each model's rank on each metric (long form)."""
    comp = comparison(spark, sf)
    return ev.rankings(comp, RANKED_METRICS)


REPORT_COLS = COMPARISON_COLS + ["pr_auc", "cost_per_transaction", "fraud_prevention_savings"]


def sql_number(c: str) -> str:
    return f"coalesce(CAST(CAST(round(CAST({c} AS DOUBLE), 4) AS DECIMAL(24,4)) AS VARCHAR), 'n/a')"


def sql_part(start: int, title: str, columns: list[tuple[str, str]]) -> str:
    shown = [(c, text) for c, text in columns if c in REPORT_COLS]
    return f"UNION ALL SELECT 1000 * (1 + model_idx) + {start}, '{title}' FROM rep\n" + "\n".join(
        f"UNION ALL SELECT 1000 * (1 + model_idx) + {start + 1 + i}, '- {text}: ' || {sql_number(c)} FROM rep" for i, (c, text) in enumerate(shown))


@query("eval_report", sql=SQL_COMPARISON + f"""
, rep AS (SELECT cmp.*, round(ap.pr_auc, 6) AS pr_auc, cm.fn * 1000 AS fraud_prevention_savings,
    round(CAST(cmp.total_cost AS DOUBLE) / (cm.tn + cm.fp + cm.fn + cm.tp), 6) AS cost_per_transaction
  FROM cmp JOIN ap ON cmp.model = ap.model JOIN cm ON cmp.model = cm.model),
best AS (SELECT arg_max(model, struct_pack(a := f1_score, b := -model_idx)) AS f, arg_max(model, struct_pack(a := roc_auc, b := -model_idx)) AS r,
    arg_max(model, struct_pack(a := roi, b := -model_idx)) FILTER (WHERE roi IS NOT NULL) AS o FROM rep)
SELECT CAST(line_no AS BIGINT) AS line_no, text FROM (
SELECT unnest([0, 1, 2, 100, 101, 102, 103]) AS line_no, unnest(['{report.TITLE}', '', '## Summary', '', '## Side by side',
  '| Model | {" | ".join(t for _, t in report.TABLE_COLUMNS)} |', '|{"---|" * (1 + len(report.TABLE_COLUMNS))}']) AS text
UNION ALL SELECT 3, '- {report.CRITERIA[0][1]}: ' || coalesce(upper(f), 'none') || ' (' || {sql_number("f1_score")} || ')' FROM best LEFT JOIN rep ON model = f
UNION ALL SELECT 4, '- {report.CRITERIA[1][1]}: ' || coalesce(upper(r), 'none') || ' (' || {sql_number("roc_auc")} || ')' FROM best LEFT JOIN rep ON model = r
UNION ALL SELECT 5, '- {report.CRITERIA[2][1]}: ' || coalesce(upper(o), 'none') || ' (' || {sql_number("roi")} || ')' FROM best LEFT JOIN rep ON model = o
UNION ALL SELECT 104 + model_idx, '| ' || model || ' | ' || {" || ' | ' || ".join(sql_number(c) for c, _ in report.TABLE_COLUMNS)} || ' |' FROM rep
UNION ALL SELECT 1000 * (1 + model_idx), '' FROM rep
UNION ALL SELECT 1000 * (1 + model_idx) + 1, '## ' || upper(model) FROM rep
{sql_part(10, "### Metrics", report.METRICS)}
{sql_part(30, "### What errors cost", report.COSTS)}
UNION ALL SELECT 1000 * (1 + model_idx) + 50, '### Strongest features' FROM rep
UNION ALL SELECT 1000 * (1 + model_idx) + 51, 'not available' FROM rep
UNION ALL SELECT {report.LAST}, '' UNION ALL SELECT {report.LAST + 1}, '## Which to take'
UNION ALL SELECT {report.LAST + 2}, CASE WHEN f = r AND o = f THEN upper(f) || ' is ahead on F1, ROC AUC and return: take it.'
  ELSE 'No model is ahead on all three: choose by what matters most, or combine them.' END FROM best)""")
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation report as numbered Markdown lines (and written as a text
    file into the shared folder)."""
    a = all_models(spark, sf)
    comp = cut_lineage(_r6(a.select(*REPORT_COLS, "model_idx"), ["model"]), "comparison")
    lines = report.markdown_lines(comp, ev.best_models(comp))
    files.write_text(lines.orderBy("line_no").select("text"),
                     files.scratch_path(spark, "evaluation-report"))
    return lines
