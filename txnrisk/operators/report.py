"""The evaluation report as numbered Markdown lines, assembled with DataFrame
operations from the comparison table (one row per model), the per-criterion
winners and, where there are any, feature importances.

Line numbers leave room: 0-99 the summary, 100-999 the comparison, then 1000 a
model (its metrics, what its errors cost, its ten strongest features), last the
recommendation.  Parts whose columns the comparison lacks are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TITLE = "# How the models did"
CRITERIA = [("f1_score", "Highest F1"), ("roc_auc", "Largest area under the ROC curve"), ("roi", "Highest return")]
TABLE_COLUMNS = [("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"), ("f1_score", "F1"), ("roc_auc", "ROC AUC"),
                 ("total_cost", "Total cost"), ("roi", "ROI"), ("cv_mean", "CV mean")]
METRICS = [("accuracy", "accuracy"), ("precision", "precision"), ("recall", "recall"), ("f1_score", "F1"), ("roc_auc", "ROC AUC"),
           ("pr_auc", "PR AUC"), ("cv_mean", "cross-validation mean")]
COSTS = [("total_cost", "total cost"), ("cost_per_transaction", "cost per transaction"), ("fraud_prevention_savings", "missed fraud"), ("roi", "return")]
TOP_FEATURES = 10
LAST = 1_000_000_000


def number(c: Column) -> Column:
    """Four decimals, or ``n/a``."""
    return F.coalesce(F.round(c.cast("double"), 4).cast("decimal(24,4)").cast("string"), F.lit("n/a"))


def _lines(df: DataFrame, *lines: tuple[Column, Column]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(n.cast("long").alias("line_no"), t.alias("text")) for n, t in lines])))


def _fixed(df: DataFrame, lines: list[tuple[int, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(lines, "line_no long, text string")


def importance_table(comp: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """``(model, available, place, feature, importance)``: the strongest features of each model
    of ``comp``, or one row with ``available`` false.  ``importance(model, feature, importance)``."""
    models = comp.select("model").distinct()
    if importance is None:
        importance = comp.sparkSession.createDataFrame([], "model string, feature string, importance double")
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature"))   # features, not rows
    top = importance.withColumn("place", place).where(F.col("place") <= TOP_FEATURES)
    return models.join(top, "model", "left").select("model", F.col("feature").isNotNull().alias("available"), "place", "feature", "importance")


def markdown_lines(comp: DataFrame, best: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    first = 1000 * (1 + F.col("model_idx"))
    name = F.upper("model")
    head = _fixed(comp, [(0, TITLE), (1, ""), (2, "## Summary"), (100, ""), (101, "## Side by side"),
                         (102, "| Model | " + " | ".join(label for c, label in TABLE_COLUMNS if c in comp.columns) + " |"),
                         (103, "|" + "---|" * (1 + sum(c in comp.columns for c, _ in TABLE_COLUMNS)))])
    order = F.create_map(*[F.lit(x) for i, (c, _) in enumerate(CRITERIA) for x in (c, i)])
    label = F.create_map(*[F.lit(x) for c, text in CRITERIA for x in (c, text)])
    value = F.create_map(*[x for c, _ in CRITERIA for x in (F.lit(c), F.col(c).cast("double"))])
    criterion = F.col("criterion")
    picks = _lines(best.where(criterion != "recommended").join(comp, "model", "left"), (
        3 + order[criterion], F.concat(F.lit("- "), label[criterion], F.lit(": "), F.coalesce(name, F.lit("none")), F.lit(" ("),
                                       number(value[criterion]), F.lit(")"))))
    cells = [number(F.col(c)) for c, _ in TABLE_COLUMNS if c in comp.columns]
    rows = _lines(comp, (104 + F.col("model_idx"), F.concat(F.lit("| "), F.concat_ws(" | ", "model", *cells), F.lit(" |"))))

    def part(start: int, title: str, columns: list[tuple[str, str]]) -> list[tuple[Column, Column]]:
        shown = [(c, text) for c, text in columns if c in comp.columns]
        return [(first + start, F.lit(title))] + [
            (first + start + 1 + i, F.concat(F.lit(f"- {text}: "), number(F.col(c)))) for i, (c, text) in enumerate(shown)] if shown else []

    sections = _lines(comp, (first, F.lit("")), (first + 1, F.concat(F.lit("## "), name)),
                      *part(10, "### Metrics", METRICS), *part(30, "### What errors cost", COSTS), (first + 50, F.lit("### Strongest features")))
    features = _lines(importance_table(comp, importance).join(comp.select("model", "model_idx"), "model"), (
        first + 50 + F.coalesce("place", F.lit(1)), F.when(F.col("available"), F.concat(
            F.col("place").cast("string"), F.lit(". "), F.col("feature"), F.lit(": "), number(F.col("importance")))).otherwise("not available")))
    advice = _lines(best.where(criterion == "recommended"), (F.lit(LAST), F.lit("")), (F.lit(LAST + 1), F.lit("## Which to take")), (
        F.lit(LAST + 2), F.when(F.col("model").isNotNull(), F.concat(name, F.lit(" is ahead on F1, ROC AUC and return: take it.")))
        .otherwise("No model is ahead on all three: choose by what matters most, or combine them.")))
    return reduce(DataFrame.unionByName, [head, picks, rows, sections, features, advice])
