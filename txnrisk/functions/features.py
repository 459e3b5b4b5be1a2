"""Column expressions for the derived transaction features (all JVM-side).

Every function returns a ``Column``; ``derive_features`` composes them and,
like the reference, derives a feature only when its input columns exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators import keyed
from txnrisk.operators.joins import broadcast_table

# --- fixed values (must equal the reference's) -------------------------------
HIGH_RISK_LOCATIONS = ["international"]
HIGH_RISK_MERCHANTS = ["electronics", "luxury", "gambling", "cryptocurrency", "unknown"]
WEEKEND_DAYS = [5, 6]                      # Monday = 0
NIGHT_FROM_HOUR, NIGHT_TO_HOUR = 22, 5     # night: hour >= 22 or hour <= 5
BUSINESS_FROM_HOUR, BUSINESS_TO_HOUR = 9, 17
# amount bins, right-closed: (0,50] (50,200] (200,500] (500,2000] (2000,inf)
AMOUNT_BIN_EDGES = [0, 50, 200, 500, 2000]
AMOUNT_BIN_LABELS = ["very_low", "low", "medium", "high", "very_high"]
# ------------------------------------------------------------------------------


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# money is exact to 8 decimal places and up to 10^20; means of money are computed on decimals
# (one HALF_UP rounding at 8 places), so equal inputs give equal doubles on
# every engine whatever the summation order
MONEY = "decimal(28,8)"
MEAN_SCALE = 8


def money_avg(x) -> Column:
    return F.round(F.avg(c(x).cast(MONEY)), MEAN_SCALE).cast("double")


def nan_to_null(x) -> Column:
    """NaN is larger than every number in Spark; the reference treats it as missing."""
    return F.nanvl(c(x).cast("double"), F.lit(None).cast("double"))


def flag(condition: Column) -> Column:
    """1 or 0; a condition on a missing value is not met."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def parse_timestamp(x) -> Column:
    """Text to a zone-free timestamp; unparseable text gives NULL, not an error."""
    return F.try_to_timestamp(c(x)).cast("timestamp_ntz")


def padded_id(prefix: str, n, width: int) -> Column:
    """Zero-padded identifier, e.g. ``CUST_000042``."""
    return F.format_string(f"{prefix}%0{width}d", c(n))


def at_time_of_day(ts, hour, minute=0) -> Column:
    """The same day at ``hour:minute`` (zone-free)."""
    h = F.lit(hour) if isinstance(hour, int) else c(hour)
    m = F.lit(minute) if isinstance(minute, int) else c(minute)
    return F.date_trunc("day", c(ts)) + F.make_dt_interval(hours=h, mins=m)


def hour_of(ts) -> Column:
    return F.hour(c(ts))


def day_of_week(ts) -> Column:
    return F.weekday(c(ts))  # Monday = 0, as pandas ``dayofweek``


def is_weekend(ts) -> Column:
    return flag(day_of_week(ts).isin(*WEEKEND_DAYS))


def is_night(ts) -> Column:
    h = hour_of(ts)
    return flag((h >= NIGHT_FROM_HOUR) | (h <= NIGHT_TO_HOUR))


def is_business_hours(ts) -> Column:
    return flag(hour_of(ts).between(BUSINESS_FROM_HOUR, BUSINESS_TO_HOUR))


def log_amount(amount) -> Column:
    return F.log1p(c(amount))


def amount_category(amount) -> Column:
    """Right-closed bins; amount <= 0 or NULL gives NULL (``Bucketizer`` is
    left-closed, so it is not used)."""
    a = nan_to_null(amount)
    expr = F.when(a <= AMOUNT_BIN_EDGES[0], None)
    for edge, label in zip(AMOUNT_BIN_EDGES[1:], AMOUNT_BIN_LABELS[:-1]):
        expr = expr.when(a <= edge, label)
    return expr.when(a.isNotNull(), AMOUNT_BIN_LABELS[-1])


def amount_to_income_ratio(amount, income) -> Column:
    return F.try_divide(c(amount), F.try_divide(c(income), F.lit(12.0)))


def amount_to_balance_ratio(amount, balance) -> Column:
    return F.try_divide(c(amount), c(balance))


def balance_impact(amount, balance) -> Column:
    return F.try_divide(c(amount), c(balance) + c(amount))


def is_high_risk_location(location) -> Column:
    return flag(c(location).isin(*HIGH_RISK_LOCATIONS))


def is_high_risk_merchant(merchant) -> Column:
    return flag(c(merchant).isin(*HIGH_RISK_MERCHANTS))


def is_mobile_device(device) -> Column:
    return flag(c(device) == "mobile")


def amount_deviation(amount, mean, std) -> Column:
    return (c(amount) - c(mean)) / (c(std) + 1)


def is_amount_above_avg(amount, mean) -> Column:
    return flag((c(amount) > c(mean)) & ~F.isnan(c(amount)))


def clamp(x, lo=None, hi=None) -> Column:
    """``greatest``/``least`` skip NULLs, so guard to keep NULL in, NULL out."""
    v = c(x)
    out = v
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(v.isNotNull(), out)


TIME_FEATURES = ["hour", "day_of_week", "is_weekend", "is_night", "is_business_hours"]
CUSTOMER_FEATURES = ["customer_transaction_count", "customer_avg_amount", "customer_amount_std"]


def derive_features(df: DataFrame, ts: str = "event_time", key: str = "customer_id",
                    profile: DataFrame | None = None) -> DataFrame:
    """All derived features (time, amount, ratios, flags, per-customer
    behaviour).  Each group is added only if its inputs are present.  With
    ``profile``, a fitted table of customer statistics, those are joined
    instead of being computed from ``df``'s own rows."""
    cols = set(df.columns)
    out = df
    if ts in cols:
        out = out.withColumns({
            "hour": hour_of(ts), "day_of_week": day_of_week(ts), "is_weekend": is_weekend(ts),
            "is_night": is_night(ts), "is_business_hours": is_business_hours(ts)})
    if "amount" in cols:
        out = out.withColumns({"log_amount": log_amount("amount"),
                               "amount_category": amount_category("amount")})
    if {"amount", "income"} <= cols:
        out = out.withColumn("amount_to_income_ratio", amount_to_income_ratio("amount", "income"))
    if {"amount", "account_balance"} <= cols:
        out = out.withColumns({
            "amount_to_balance_ratio": amount_to_balance_ratio("amount", "account_balance"),
            "balance_impact": balance_impact("amount", "account_balance")})
    if "location" in cols:
        out = out.withColumn("is_high_risk_location", is_high_risk_location("location"))
    if "merchant_category" in cols:
        out = out.withColumn("is_high_risk_merchant", is_high_risk_merchant("merchant_category"))
    if "device_type" in cols:
        out = out.withColumn("is_mobile_device", is_mobile_device("device_type"))
    if key in cols and "amount" in cols:
        out = (keyed.attach_key_stats(out, key, "amount", *CUSTOMER_FEATURES) if profile is None
               else out.join(broadcast_table(profile), key, "left"))
        out = out.withColumns({
            "amount_deviation": amount_deviation("amount", "customer_avg_amount",
                                                 "customer_amount_std"),
            "is_amount_above_avg": is_amount_above_avg("amount", "customer_avg_amount")})
    return out
