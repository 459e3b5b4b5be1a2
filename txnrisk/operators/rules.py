"""Fraud-pattern rules, re-aimed from the reference's generator patterns.

Each rule adds a 0/1 flag column.  Per-customer context comes from
``operators.keyed`` (aggregate + join, two-level windows); first-use
detection is a pair of ``min(struct(ts, id))`` aggregates, so no rule runs a
window partitioned by customer alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import features as fx
from txnrisk.operators import keyed
from txnrisk.operators.joins import sized_join

# --- fixed values -------------------------------------------------------------
HIGH_AMOUNT_FACTOR = 5.0          # amount >= 5 x customer mean
TAKEOVER_AMOUNT_FACTOR = 2.0      # amount >= 2 x customer mean on a risky merchant
RAPID_MIN_COUNT = 3               # >= 3 transactions in the trailing hour
UNUSUAL_HOUR_FROM, UNUSUAL_HOUR_TO = 2, 5
RULES = ["high_amount", "rapid_sequence", "unusual_location", "unusual_time",
         "new_merchant", "account_takeover"]
# ------------------------------------------------------------------------------

ID, KEY, TS = "transaction_id", "customer_id", "event_time"


def _with_mean(df: DataFrame) -> DataFrame:
    if "_cust_mean" in df.columns:
        return df
    stats = df.groupBy(KEY).agg(F.avg("amount").alias("_cust_mean"))
    return keyed.attach(df, stats, KEY)


def high_amount(df: DataFrame) -> DataFrame:
    df = _with_mean(df)
    return df.withColumn("high_amount", F.coalesce(
        (F.col("amount") >= HIGH_AMOUNT_FACTOR * F.col("_cust_mean")).cast("int"), F.lit(0)))


def rapid_sequence(df: DataFrame) -> DataFrame:
    out = keyed.trailing_count(df, KEY, TS, out="_n_last_hour", unit="hour")
    return out.withColumn("rapid_sequence", F.coalesce(
        (F.col("_n_last_hour") >= RAPID_MIN_COUNT).cast("int"), F.lit(0))).drop("_n_last_hour")


def unusual_location(df: DataFrame) -> DataFrame:
    return df.withColumn("unusual_location", fx.is_high_risk_location("location"))


def unusual_time(df: DataFrame) -> DataFrame:
    return df.withColumn("unusual_time", fx.flag(F.hour(TS).between(
        UNUSUAL_HOUR_FROM, UNUSUAL_HOUR_TO)))


def new_merchant(df: DataFrame) -> DataFrame:
    """Risky merchant, or the customer's first use of a category after some
    earlier activity.  "First" is in ``(event_time, transaction_id)`` order.  One
    aggregate by customer and category, folded to a row a customer with the ids
    of its first uses; the side grows with the customers, and no row but those
    of a customer beyond the broadcast bound is shuffled."""
    used = (df.where(F.col(KEY).isNotNull()).groupBy(KEY, "merchant_category")
            .agg(F.min(F.struct(TS, ID)).alias("_first")))
    # categories, not rows, per customer; the earliest of them is the customer's first transaction
    novel = used.groupBy(KEY).agg(F.array_sort(F.collect_list("_first")).alias("_f")).select(
        KEY, F.transform(F.slice("_f", F.lit(2), F.greatest(F.size("_f") - 1, F.lit(0))), lambda x: x[ID]).alias("_novel"))
    out = sized_join(df, novel, KEY, "left")
    first = F.coalesce(F.array_contains("_novel", F.col(ID)).cast("int"), F.lit(0))
    return out.withColumn("new_merchant", F.greatest(fx.is_high_risk_merchant("merchant_category"), first)).drop("_novel")


def account_takeover(df: DataFrame) -> DataFrame:
    df = _with_mean(df)
    hit = ((F.col("amount") >= TAKEOVER_AMOUNT_FACTOR * F.col("_cust_mean"))
           & (fx.is_high_risk_merchant("merchant_category") == 1))
    return df.withColumn("account_takeover", F.coalesce(hit.cast("int"), F.lit(0)))


RULE_FNS = {"high_amount": high_amount, "rapid_sequence": rapid_sequence,
            "unusual_location": unusual_location, "unusual_time": unusual_time,
            "new_merchant": new_merchant, "account_takeover": account_takeover}


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    out = df
    for r in rules:
        out = RULE_FNS[r](out)
    n_hits = sum((F.col(r) for r in rules), F.lit(0))
    return out.withColumn("n_hits", n_hits).drop("_cust_mean")


def rule_hits(df: DataFrame, rule: str) -> DataFrame:
    return RULE_FNS[rule](df).where(F.col(rule) == 1).select(ID, KEY, "amount")
