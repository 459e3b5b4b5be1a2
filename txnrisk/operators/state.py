"""Fit / transform state: label encoding with unseen handling, median
imputation, standard scaling, stratified split, k-fold assignment, class
weights, and the fitted preprocessor that chains them.

Fitting produces small tables (one row per category value, or per feature);
applying them is a join or a pure column expression.  Nothing here collects a
table whose size grows with the rows: vocabularies stay DataFrames and are
joined, per-feature statistics (one number per feature) become literals.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnrisk.functions import features as fx
from txnrisk.operators import keyed
from txnrisk.operators.joins import is_small
from txnrisk.operators.quantile import quantiles
from txnrisk.operators.ranking import ranked
from txnrisk.session import cut_lineage

# --- fixed values ---------------------------------------------------------------
CATEGORICAL = ["merchant_category", "location", "transaction_type", "device_type",
               "amount_category"]
UNKNOWN = "unknown"
NULL_TEXT = "nan"                 # pandas' string form of a missing value
TEST_CUT = "3333"                 # md5 prefix below this -> test (20 %)
FOLD_CUTS = ["3333", "6666", "9999", "cccc"]   # -> folds 0..4
EXCLUDED = ["is_fraud", "transaction_id", "customer_id", "timestamp", "event_time",
            "fraud_type", *CATEGORICAL]
# ----------------------------------------------------------------------------------


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(NULL_TEXT))


# --- split and folds (order-free, reproducible on any engine) ------------------------

def _hash_hex(id_col: str, start: int) -> Column:
    return F.substring(F.md5(F.col(id_col).cast("string")), start, 4)


def split_stratified(df: DataFrame, id_col: str) -> DataFrame:
    """20 % test by an id hash: each row decides alone, so the split is
    stratified in expectation and identical across runs and partitionings."""
    return df.withColumn("is_test", _hash_hex(id_col, 1) < TEST_CUT)


def kfold_assign(df: DataFrame, id_col: str) -> DataFrame:
    h = _hash_hex(id_col, 5)
    expr = None
    for i, cut in enumerate(FOLD_CUTS):
        expr = F.when(h < cut, i) if expr is None else expr.when(h < cut, i)
    return df.withColumn("fold", expr.otherwise(len(FOLD_CUTS)))


def split_exact(df: DataFrame, id_col: str, label: str = "is_fraud", test_share: float = 0.2) -> DataFrame:
    """``is_test`` for exactly ``round(test_share * n)`` rows of each class, the first by an id hash."""
    r = _by_hash(df, id_col, label, "split")
    return r.withColumn("is_test", F.col("_place") < F.round(F.lit(test_share) * F.col("_total"))).drop("_hash", "_place", "_total")


def kfold_exact(df: DataFrame, id_col: str, label: str = "is_fraud", n_folds: int = 5) -> DataFrame:
    """``fold`` by turns in each class's hash order, a class going on at the fold where the one before
    it ends: folds differ by one row at most, in each class and as a whole."""
    r = _by_hash(df, id_col, label, "fold")
    classes = r.groupBy(F.col(label).alias("_class")).agg(F.max("_total").alias("_n"))       # a row a class
    start = classes.select("_class", (F.sum("_n").over(Window.orderBy("_class")) - F.col("_n")).alias("_start"))
    r = r.join(F.broadcast(start), F.col(label).eqNullSafe(F.col("_class")))
    return r.withColumn("fold", ((F.col("_place") + F.col("_start")) % n_folds).cast("int")).drop("_hash", "_place", "_total", "_class", "_start")


def _by_hash(df: DataFrame, id_col: str, label: str, salt: str) -> DataFrame:
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(salt), F.col(id_col).cast("string"))))
    return ranked(hashed, [label], ["_hash", id_col], "_place", "_total")


def class_weights(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Balanced weights n / (n_classes * n_class), one row per class: the
    per-class counts (one row per class) are gathered into one row, then
    exploded back with the totals."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    one = per.agg(F.collect_list(F.struct(label, "n_class")).alias("c"),
                  F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return one.select(F.explode("c").alias("e"), "n", "k").select(
        F.col(f"e.{label}").alias(label),
        (F.col("n") / (F.col("k") * F.col("e.n_class"))).alias("weight"))


def with_weight(df: DataFrame, weights: DataFrame, label: str = "is_fraud") -> DataFrame:
    return df.join(F.broadcast(weights), label, "left")   # one row per class


# --- label encoding -------------------------------------------------------------------

def fit_vocabulary(df: DataFrame, cols: Sequence[str] = CATEGORICAL) -> DataFrame:
    """``(column_name, value, code)``: codes are the lexicographic rank of the
    value's text within its column (NULL -> 'nan')."""
    cols = [c for c in cols if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _text(c).alias("value"))
                      for c in cols])
    distinct = df.select(F.inline(pairs)).distinct()
    codes = ranked(distinct, ["column_name"], ["value"], "code")     # a column may have any number of values
    return codes.select("column_name", "value", F.col("code").cast("int").alias("code"))


def vocabulary_info(vocab: DataFrame) -> dict[str, tuple[int, int | None]]:
    """Per column: (size, code of 'unknown' or None) -- one row per column."""
    rows = (vocab.groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.max(F.when(F.col("value") == UNKNOWN, F.col("code"))).alias("unk"))
            .collect())
    return {r["column_name"]: (r["n"], r["unk"]) for r in rows}


def encode(df: DataFrame, vocab: DataFrame, cols: Sequence[str] = CATEGORICAL,
           info: dict | None = None, materialized: bool = False) -> DataFrame:
    """Adds ``<col>_encoded``.  Unseen values become 'unknown': its code when
    the vocabulary has it, else one past the last code.  The vocabulary is
    materialised once and its size checked once; each column's slice is
    broadcast when the whole is small, else sort-merge joined."""
    if not materialized:
        vocab = cut_lineage(vocab, "vocab")
    info = info or vocabulary_info(vocab)
    small = is_small(vocab)
    out = df
    for c in cols:
        if c not in df.columns or c not in info:
            continue
        size, unk = info[c]
        v = vocab.where(F.col("column_name") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        v = F.broadcast(v) if small else v
        out = out.join(v, _text(c) == F.col(f"_v_{c}"), "left")
        fallback = F.lit(unk if unk is not None else size)
        out = out.withColumn(f"{c}_encoded", F.coalesce(F.col(f"_c_{c}"), fallback)) \
                 .drop(f"_v_{c}", f"_c_{c}")
    return out


# --- imputation and scaling -----------------------------------------------------------

def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                                        for c in cols])))


def fit_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table ``(feature, median_value)``, exact at any size; NULL for a
    column without values."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"))
    med = quantiles(_long(df, cols), [0.5]).select("feature", F.col("quantile").alias("median_value"))
    return names.join(med, "feature", "left")


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table ``(feature, mean_value, std_pop)`` -- population std, as the
    reference's scaler (Spark ML's StandardScaler uses the sample std)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
    wide = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("mean_value"),
                               F.col(f"{c}__s").alias("std_pop")) for c in cols])
    return wide.select(F.inline(pairs))


def fit_median_and_scaler(df: DataFrame, cols: Sequence[str]):
    """Medians and the mean / population std of the median-imputed columns.
    With ``k`` of ``n`` values present and median ``m``, the imputed column has
    sum ``s + (n-k) m`` and square sum ``q + (n-k) m^2``."""
    med = {r["feature"]: r["median_value"] for r in fit_medians(df, cols).collect()}   # one row per feature
    aggs = []
    for c in cols:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.count(x).alias(f"{c}__k"), F.sum(x).alias(f"{c}__s"), F.sum(x * x).alias(f"{c}__q")]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    stats = {c: {"n": wide["n"], "m": med.get(c), "k": wide[f"{c}__k"], "s": wide[f"{c}__s"], "q": wide[f"{c}__q"]}
             for c in cols}
    medians, scaler = {}, {}
    for c in cols:
        r = stats.get(c)
        if r is None or not r["n"]:
            medians[c], scaler[c] = None, (0.0, 0.0)
            continue
        n, m, k = r["n"], r["m"], r["k"]
        fill = m if m is not None else 0.0
        s_, q = r["s"] or 0.0, r["q"] or 0.0
        mean = (s_ + (n - k) * fill) / n
        var = max(0.0, (q + (n - k) * fill * fill) / n - mean * mean)
        medians[c], scaler[c] = m, (mean, var ** 0.5)
    return medians, scaler


def impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Stored medians first, then 0 for what is still missing."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m), F.lit(0.0))
                           if m is not None else F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                           for c, m in medians.items()})


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std; a flat column divides by 1."""
    out = {}
    for c, (m, s) in stats.items():
        s = s if s else 1.0
        out[c] = (F.col(c).cast("double") - F.lit(m if m is not None else 0.0)) / F.lit(s)
    return df.withColumns(out)


def feature_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns from the schema, minus ids, target and
    time columns."""
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in ("is_fraud", "transaction_id", "customer_id", "timestamp", "event_time",
                      "fraud_type"):
            continue
        t = f.dataType.typeName()
        if t in ("integer", "long", "double", "float", "short", "byte", "decimal"):
            numeric.append(f.name)
        elif t == "string":
            categorical.append(f.name)
    return numeric, categorical


# --- the fitted preprocessor ----------------------------------------------------------

FEATURE_ORDER = [
    "amount", "age", "income", "account_balance", "account_age_days", "credit_score",
    "transaction_frequency", "amount_to_income_ratio", "amount_to_balance_ratio", "hour",
    "day_of_week", "is_weekend", "is_night", "is_business_hours", "log_amount",
    "balance_impact", "is_high_risk_location", "is_high_risk_merchant", "is_mobile_device",
    "customer_transaction_count", "customer_avg_amount", "customer_amount_std",
    "amount_deviation", "is_amount_above_avg", "merchant_category_encoded",
    "location_encoded", "transaction_type_encoded", "device_type_encoded",
    "amount_category_encoded"]


@dataclass
class Preprocessor:
    """Fitted state: vocabulary table, customer statistics, per-feature medians
    and scaler statistics, and the frozen feature order.  Rows are transformed
    with the statistics of the training rows, one by one or as a table; a
    customer unknown to them gets the imputed values."""
    vocab: DataFrame
    profile: DataFrame
    vocab_info: dict
    medians: dict[str, float | None]
    scaler: dict[str, tuple[float, float]]
    feature_columns: list[str] = field(default_factory=lambda: list(FEATURE_ORDER))

    @staticmethod
    def select_features(df: DataFrame) -> list[str]:
        """Numeric columns not excluded, in the fitted order."""
        numeric = {f.name for f in df.schema.fields
                   if f.dataType.typeName() in ("integer", "long", "double", "float")}
        return [c for c in FEATURE_ORDER if c in numeric and c not in EXCLUDED]

    @classmethod
    def fit(cls, df: DataFrame) -> Preprocessor:
        """Two passes over the training rows: the vocabulary (materialised --
        it is small fitted state, joined five times later), then the medians and
        the moments the scaler needs."""
        profile = cut_lineage(keyed.key_stats(df.where(F.col("customer_id").isNotNull()), "customer_id", "amount",
                                              *fx.CUSTOMER_FEATURES), "customer-profile")
        feats = fx.derive_features(df, profile=profile)
        vocab = cut_lineage(fit_vocabulary(feats), "vocab")
        info = vocabulary_info(vocab)
        enc = encode(feats, vocab, info=info, materialized=True)
        cols = cls.select_features(enc)
        med, sc = fit_median_and_scaler(enc, cols)
        return cls(vocab=vocab, profile=profile, vocab_info=info, medians=med, scaler=sc, feature_columns=cols)

    def transform(self, df: DataFrame, keep: Sequence[str] = ("transaction_id",)) -> DataFrame:
        feats = fx.derive_features(df, profile=self.profile)
        enc = encode(feats, self.vocab, info=self.vocab_info, materialized=True)
        missing = [c for c in self.feature_columns if c not in enc.columns]
        if missing:
            raise ValueError(f"missing feature columns: {missing}")
        out = scale(impute(enc, self.medians), self.scaler)
        label = [F.col("is_fraud").alias("label")] if "is_fraud" in df.columns else []
        keep = [k for k in keep if k not in self.feature_columns]   # features come scaled
        return out.select(*keep, *label, *self.feature_columns)

    # persistence: vocabulary and customer statistics as Parquet, the numbers as one JSON document
    def save(self, path: str) -> None:
        spark = self.vocab.sparkSession
        self.vocab.write.mode("overwrite").parquet(os.path.join(path, "vocab"))
        self.profile.write.mode("overwrite").parquet(os.path.join(path, "profile"))
        doc = json.dumps({"medians": self.medians, "scaler": self.scaler,
                          "feature_columns": self.feature_columns,
                          "vocab_info": {k: list(v) for k, v in self.vocab_info.items()}})
        spark.createDataFrame([(doc,)], "state string").coalesce(1).write.mode("overwrite") \
             .text(os.path.join(path, "state"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        vocab = spark.read.parquet(os.path.join(path, "vocab"))
        doc = json.loads(spark.read.text(os.path.join(path, "state")).first()[0])
        return cls(vocab=vocab, profile=spark.read.parquet(os.path.join(path, "profile")), vocab_info={k: tuple(v) for k, v in doc["vocab_info"].items()},
                   medians=doc["medians"],
                   scaler={k: tuple(v) for k, v in doc["scaler"].items()},
                   feature_columns=doc["feature_columns"])


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)
