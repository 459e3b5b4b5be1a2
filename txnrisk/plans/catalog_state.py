"""Catalogue, part 2: fitted state -- vocabulary, encoding, medians, scaler,
split, folds, class weights and the whole preprocessor."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import features as fx
from txnrisk.operators import keyed, state
from txnrisk.plans.catalog_features import (FEATURES_24, SQL_AMOUNT_CATEGORY, SQL_CUST_STATS,
                                            SQL_FLAGS, SQL_TIME, features_24)
from txnrisk.plans.catalog_features import sql_money_avg
from txnrisk.plans.registry import query
from txnrisk.sources import fixtures
from txnrisk.sources.tables import read_table

ID = "transaction_id"
SCALED = ["amount", "age", "income", "account_balance"]

# SQL helpers -------------------------------------------------------------------------
SQL_FEATURES = SQL_CUST_STATS.format(src="txn") + f"""
, ff AS (SELECT transaction_id, amount, age, income, account_balance, account_age_days, credit_score,
  transaction_frequency, amount / NULLIF(income / 12, 0) AS amount_to_income_ratio,
  amount / NULLIF(account_balance, 0) AS amount_to_balance_ratio, {SQL_TIME},
  ln(1 + amount) AS log_amount, amount / NULLIF(account_balance + amount, 0) AS balance_impact, {SQL_FLAGS},
  customer_transaction_count, customer_avg_amount, customer_amount_std, amount_deviation,
  is_amount_above_avg FROM fs)
"""


def sql_vocab(src: str, cols: list[str], name: str = "voc") -> str:
    parts = []
    for c in cols:
        expr = SQL_AMOUNT_CATEGORY if c == "amount_category" else c
        parts.append(f"SELECT '{c}' AS column_name, COALESCE(CAST({expr} AS VARCHAR), 'nan') AS value "
                     f"FROM {src}")
    union = "\n  UNION ALL ".join(parts)
    return f"""
, {name}_l AS ({union})
, {name} AS (SELECT column_name, value,
    CAST(dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT column_name, value FROM {name}_l))
"""


def sql_encoded(c: str, voc: str = "voc", alias: str = "t") -> str:
    expr = SQL_AMOUNT_CATEGORY.replace("amount", f"{alias}.amount") if c == "amount_category" \
        else f"{alias}.{c}"
    return f"""COALESCE((SELECT code FROM {voc} WHERE column_name = '{c}'
      AND value = COALESCE(CAST({expr} AS VARCHAR), 'nan')),
    (SELECT code FROM {voc} WHERE column_name = '{c}' AND value = 'unknown'),
    (SELECT CAST(count(*) AS INTEGER) FROM {voc} WHERE column_name = '{c}')) AS {c}_encoded"""


# --- vocabulary and encoding ---------------------------------------------------------------

def _txn_with_category(spark, sf):
    t = fixtures.base_txn(spark, sf)
    return t.withColumn("amount_category", fx.amount_category("amount"))


@query("cat_vocabulary", sql=sql_vocab("txn", state.CATEGORICAL) + """
SELECT column_name, value, code FROM voc""")
def cat_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return state.fit_vocabulary(_txn_with_category(spark, sf))


@query("encode_labels", sql=sql_vocab("txn", state.CATEGORICAL) + f"""
SELECT t.transaction_id, {', '.join(sql_encoded(c) for c in state.CATEGORICAL)} FROM txn t""")
def encode_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = _txn_with_category(spark, sf)
    vocab = state.fit_vocabulary(t)
    e = state.encode(t, vocab)
    return e.select(ID, *[f"{c}_encoded" for c in state.CATEGORICAL])


UNSEEN_COLS = ["location", "merchant_category"]


@query("encode_unseen", sql="""
, fit AS (SELECT * FROM txn WHERE location <> 'international' AND merchant_category <> 'luxury')
""" + sql_vocab("fit", UNSEEN_COLS) + f"""
SELECT t.transaction_id, {', '.join(sql_encoded(c) for c in UNSEEN_COLS)} FROM txn t""")
def encode_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on domestic, non-luxury rows; apply to all.  'international' is
    unseen and 'unknown' is not a location -> new last code; 'luxury' is unseen
    but 'unknown' is a merchant value -> that code."""
    t = fixtures.base_txn(spark, sf)
    fit = t.where((F.col("location") != "international") & (F.col("merchant_category") != "luxury"))
    vocab = state.fit_vocabulary(fit, UNSEEN_COLS)
    e = state.encode(t, vocab, UNSEEN_COLS)
    return e.select(ID, *[f"{c}_encoded" for c in UNSEEN_COLS])


# --- medians, scaler, imputation -------------------------------------------------------------

@query("agg_feature_medians", sql=SQL_FEATURES + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median_value FROM ff"
    for c in FEATURES_24))
def agg_feature_medians(spark: SparkSession, sf: str) -> DataFrame:
    m = state.fit_medians(features_24(spark, sf), FEATURES_24)
    return m.select("feature", F.round("median_value", 6).alias("median_value"))


@query("agg_scaler_stats", sql=SQL_FEATURES + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) + 0.0 AS mean_value, round(stddev_pop({c}), 6) AS std_pop "
    f"FROM ff" for c in FEATURES_24))
def agg_scaler_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = state.fit_scaler(features_24(spark, sf), FEATURES_24)
    # "+ 0.0" turns a rounded -0.0 into 0.0 on both engines
    return s.select("feature", (F.round("mean_value", 6) + 0.0).alias("mean_value"),
                    F.round("std_pop", 6).alias("std_pop"))


@query("impute_median", sql=SQL_CUST_STATS.format(src="orders_txn") + """
, md AS (SELECT quantile_cont(amount_deviation, 0.5) AS m FROM fs)
SELECT transaction_id, round(coalesce(amount_deviation, m, 0), 6) AS amount_deviation FROM fs, md""")
def impute_median(spark: SparkSession, sf: str) -> DataFrame:
    d = keyed.attach_key_stats(fixtures.orders_txn(spark, sf), "customer_id", "amount",
                               *fx.CUSTOMER_FEATURES)
    d = d.withColumn("amount_deviation", fx.amount_deviation(
        "amount", "customer_avg_amount", "customer_amount_std"))
    med = {r["feature"]: r["median_value"]
           for r in state.fit_medians(d, ["amount_deviation"]).collect()}
    out = state.impute(d, med)
    return out.select(ID, F.round("amount_deviation", 6).alias("amount_deviation"))


@query("scale_standard", sql=", st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED) + " FROM txn)\nSELECT transaction_id, "
    + ", ".join(f"round(({c} - m_{c}) / CASE WHEN coalesce(s_{c}, 0) = 0 THEN 1 ELSE s_{c} END, 6) AS {c}"
                for c in SCALED) + " FROM txn, st")
def scale_standard(spark: SparkSession, sf: str) -> DataFrame:
    t = fixtures.txn(spark, sf)
    stats = {r["feature"]: (r["mean_value"], r["std_pop"])
             for r in state.fit_scaler(t, SCALED).collect()}
    s = state.scale(t, stats)
    return s.select(ID, *[F.round(c, 6).alias(c) for c in SCALED])


# --- split, folds, weights ----------------------------------------------------------------

@query("split_stratified", sql="""
SELECT transaction_id, is_fraud, substr(md5(CAST(transaction_id AS VARCHAR)), 1, 4) < '3333' AS is_test
FROM txn""")
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return state.split_stratified(fixtures.txn(spark, sf), ID).select(ID, "is_fraud", "is_test")


@query("kfold_assign", sql="""
SELECT transaction_id, CASE WHEN substr(md5(CAST(transaction_id AS VARCHAR)), 5, 4) < '3333' THEN 0
    WHEN substr(md5(CAST(transaction_id AS VARCHAR)), 5, 4) < '6666' THEN 1
    WHEN substr(md5(CAST(transaction_id AS VARCHAR)), 5, 4) < '9999' THEN 2
    WHEN substr(md5(CAST(transaction_id AS VARCHAR)), 5, 4) < 'cccc' THEN 3 ELSE 4 END AS fold
FROM txn""")
def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return state.kfold_assign(fixtures.base_txn(spark, sf), ID).select(ID, "fold")


SQL_HASHED = """
, hashed AS (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('{salt}' || transaction_id), transaction_id) - 1 AS place,
    count(*) OVER (PARTITION BY is_fraud) AS total FROM txn)
"""


@query("split_exact", sql=SQL_HASHED.format(salt="split") + """
SELECT transaction_id, is_fraud, place < round(CAST(0.2 AS DOUBLE) * total) AS is_test FROM hashed""")
def split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return state.split_exact(fixtures.txn(spark, sf), ID).select(ID, "is_fraud", "is_test")


@query("kfold_exact", sql=SQL_HASHED.format(salt="fold") + """
, starts AS (SELECT is_fraud, sum(n) OVER (ORDER BY is_fraud) - n AS start FROM (SELECT is_fraud, count(*) AS n FROM txn GROUP BY 1))
SELECT transaction_id, CAST((place + start) % 5 AS INTEGER) AS fold FROM hashed JOIN starts USING (is_fraud)""")
def kfold_exact(spark: SparkSession, sf: str) -> DataFrame:
    return state.kfold_exact(fixtures.txn(spark, sf), ID).select(ID, "fold")


@query("codes_of_words", sql="""
, words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word AS value, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS code FROM words""")
def codes_of_words(spark: SparkSession, sf: str) -> DataFrame:
    """Vocabulary codes of a column with very many values: the words of all documents."""
    words = read_table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return state.fit_vocabulary(words, ["word"]).select("value", "code")


@query("class_weights", sql="""
SELECT is_fraud, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM txn GROUP BY is_fraud""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    w = state.class_weights(fixtures.txn(spark, sf))
    return w.select("is_fraud", F.round("weight", 6).alias("weight"))


CHECKED_FEATURES = ["amount", "log_amount", "is_night", "customer_transaction_count", "customer_avg_amount"]


@query("pipeline_fit_transform", sql=""", tr AS (SELECT * FROM txn WHERE substr(md5(CAST(transaction_id AS VARCHAR)), 1, 4) >= '3333'),
cp AS (SELECT customer_id, count(amount) AS customer_transaction_count, """ + sql_money_avg("amount") + """ AS customer_avg_amount
  FROM tr WHERE customer_id IS NOT NULL GROUP BY customer_id),
raw AS (SELECT t.transaction_id, t.is_fraud, t.amount, ln(1 + t.amount) AS log_amount,
    CAST(CASE WHEN hour(t.event_time) >= 22 OR hour(t.event_time) <= 5 THEN 1 ELSE 0 END AS DOUBLE) AS is_night,
    CAST(customer_transaction_count AS DOUBLE) AS customer_transaction_count, customer_avg_amount,
    substr(md5(CAST(t.transaction_id AS VARCHAR)), 1, 4) >= '3333' AS train
  FROM txn t LEFT JOIN cp ON t.customer_id = cp.customer_id),
md AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in CHECKED_FEATURES) + """ FROM raw WHERE train),
im AS (SELECT transaction_id, is_fraud, train, """ + ", ".join(
    f"coalesce(raw.{c}, md.{c}, 0) AS {c}" for c in CHECKED_FEATURES) + """ FROM raw, md),
sc AS (SELECT """ + ", ".join(
    f"avg({c}) AS {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}_s" for c in CHECKED_FEATURES) + """ FROM im WHERE train)
SELECT transaction_id, is_fraud AS label, 29 AS n_features, """ + ", ".join(
    f"round(({c} - {c}_m) / {c}_s + 1e-9, 6) AS {c}" for c in CHECKED_FEATURES) + " FROM im, sc")
def pipeline_fit_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Split first, fit the preprocessor (customer statistics too) on the
    training rows only, transform every row, assemble the feature vector."""
    t = state.split_stratified(fixtures.txn(spark, sf), ID)
    pre = state.Preprocessor.fit(t.where(~F.col("is_test")))
    x = state.assemble(pre.transform(t), pre.feature_columns)
    return x.select(ID, "label", F.size(vector_to_array("features")).alias("n_features"),
                    *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in CHECKED_FEATURES])


SQL_ALL_FEATURES = f"""
, tr AS (SELECT * FROM txn WHERE substr(md5(CAST(transaction_id AS VARCHAR)), 1, 4) >= '3333'),
cs AS (SELECT customer_id, count(amount) AS customer_transaction_count, {sql_money_avg("amount")} AS customer_avg_amount,
    stddev_samp(amount) AS customer_amount_std FROM tr WHERE customer_id IS NOT NULL GROUP BY customer_id),
fs AS (SELECT t.*, customer_transaction_count, customer_avg_amount, customer_amount_std,
    (amount - customer_avg_amount) / (customer_amount_std + 1) AS amount_deviation,
    CASE WHEN amount > customer_avg_amount THEN 1 ELSE 0 END AS is_amount_above_avg,
    substr(md5(CAST(transaction_id AS VARCHAR)), 1, 4) >= '3333' AS train
  FROM txn t LEFT JOIN cs ON t.customer_id = cs.customer_id)""" + sql_vocab("tr", state.CATEGORICAL) + f"""
, every AS (SELECT t.*, {SQL_TIME}, {SQL_FLAGS}, ln(1 + amount) AS log_amount, amount / NULLIF(income / 12, 0) AS amount_to_income_ratio,
    amount / NULLIF(account_balance, 0) AS amount_to_balance_ratio, amount / NULLIF(account_balance + amount, 0) AS balance_impact,
    {', '.join(sql_encoded(c) for c in state.CATEGORICAL)} FROM fs t),
raw AS (SELECT transaction_id, is_fraud, train, {', '.join(f"CAST({c} AS DOUBLE) AS {c}" for c in state.FEATURE_ORDER)} FROM every),
md AS (SELECT {', '.join(f"quantile_cont({c}, 0.5) AS {c}" for c in state.FEATURE_ORDER)} FROM raw WHERE train),
im AS (SELECT transaction_id, is_fraud, train, {', '.join(f"coalesce(raw.{c}, md.{c}, 0) AS {c}" for c in state.FEATURE_ORDER)} FROM raw, md),
sc AS (SELECT {', '.join(f"avg({c}) AS {c}_m, coalesce(nullif(stddev_pop({c}), 0), 1) AS {c}_s" for c in state.FEATURE_ORDER)} FROM im WHERE train)
"""


@query("pipeline_all_features", sql=SQL_ALL_FEATURES + "SELECT transaction_id, is_fraud AS label, " + ", ".join(
    f"round(({c} - {c}_m) / {c}_s + 1e-8, 5) AS {c}" for c in state.FEATURE_ORDER) + " FROM im, sc")
def pipeline_all_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of the fitted preprocessor, for every row."""
    t = state.split_stratified(fixtures.txn(spark, sf), ID)
    x = state.Preprocessor.fit(t.where(~F.col("is_test"))).transform(t)
    return x.select(ID, "label", *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in state.FEATURE_ORDER])
