"""Scoring policies as column expressions: ensembles, confidence, risk levels,
decisions, alerts and score calibration.  All row-wise, JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrisk.functions.features import c

# --- fixed values (must equal the reference's) -------------------------------
# strict policy (the detector): >= 0.9 critical, >= 0.8 high, >= 0.6 medium
STRICT_LEVELS = [(0.9, "critical"), (0.8, "high"), (0.6, "medium")]
STRICT_DECISION = 0.6
STRICT_ALERT_CONFIDENCE = 0.7      # alert: level high/critical and confidence > 0.7
# sensitive policy (the simple dashboard): >= 0.8 / >= 0.6 / >= 0.3
SENSITIVE_LEVELS = [(0.8, "critical"), (0.6, "high"), (0.3, "medium")]
SENSITIVE_DECISION = 0.3
LOW_LEVEL = "low"
ERROR_LEVEL = "error"
ALERT_LEVELS = ["high", "critical"]
ENSEMBLE_WEIGHTS = (0.6, 0.4)      # shipped ensemble: isolation forest, reconstruction
VOTE_THRESHOLD = 0.5
SINGLE_MODEL_DASHBOARD_CONFIDENCE = 0.5
ROW_COLORS = {"critical": "#ffebee", "high": "#fff3e0", "medium": "#f3e5f5"}
DEFAULT_ROW_COLOR = "#e8f5e8"
# ------------------------------------------------------------------------------

POLICIES = {
    "strict": (STRICT_LEVELS, STRICT_DECISION),
    "sensitive": (SENSITIVE_LEVELS, SENSITIVE_DECISION),
}


def risk_level(p, policy: str = "strict") -> Column:
    levels, _ = POLICIES[policy]
    expr = None
    for bound, name in levels:
        expr = F.when(c(p) >= bound, name) if expr is None else expr.when(c(p) >= bound, name)
    return expr.otherwise(LOW_LEVEL)


def decision(p, policy: str = "strict") -> Column:
    _, bound = POLICIES[policy]
    return F.coalesce(c(p) >= bound, F.lit(False))


def mean_of(cols: Sequence) -> Column:
    """Plain mean across model columns (0 with no model)."""
    if not cols:
        return F.lit(0.0)
    return sum((c(x) for x in cols), F.lit(0.0)) / len(cols) if len(cols) > 1 else c(cols[0])


def weighted_mean(cols: Sequence, weights: Sequence[float]) -> Column:
    total = float(sum(weights))
    return sum((c(x) * float(w) for x, w in zip(cols, weights)), F.lit(0.0)) / total


def weighted_vote(cols: Sequence, weights: Sequence[float], threshold: float = VOTE_THRESHOLD
                  ) -> Column:
    """Each model votes 0/1 at ``threshold``; fraud when the weighted mean of
    the votes is above 0.5."""
    votes = [(c(x) >= threshold).cast("double") for x in cols]
    return (weighted_mean(votes, weights) > 0.5).cast("int")


def population_variance(cols: Sequence) -> Column:
    n = len(cols)
    m = mean_of(cols)
    return sum(((c(x) - m) * (c(x) - m) for x in cols), F.lit(0.0)) / n


def confidence(cols: Sequence, variant: str = "strict") -> Column:
    """Model agreement: 1 / (1 + population variance of the scores).

    strict (detector): 0 with no model; dashboard: 0.5 with at most one model.
    """
    n = len(cols)
    if variant == "dashboard" and n <= 1:
        return F.lit(SINGLE_MODEL_DASHBOARD_CONFIDENCE)
    if n == 0:
        return F.lit(0.0)
    return 1.0 / (1.0 + population_variance(cols))


def member_score(proba, pred) -> Column:
    """A model's score: its probability when it has one, else its 0/1
    decision as a number (models without probabilities still vote)."""
    return F.coalesce(c(proba).cast("double"), c(pred).cast("double"))


def map_mean(m) -> Column:
    """Mean of a model -> probability map (0 when empty)."""
    vals = F.map_values(c(m))
    n = F.size(vals)
    total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def map_confidence(m, variant: str = "strict") -> Column:
    """Confidence from a model -> probability map, for a model set that is
    only known per row: 1 / (1 + population variance of the map values)."""
    vals = F.map_values(c(m))
    n = F.size(vals)
    mean = map_mean(m)
    var = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n
    conf = 1.0 / (1.0 + var)
    if variant == "dashboard":
        return F.when(n > 1, conf).otherwise(F.lit(SINGLE_MODEL_DASHBOARD_CONFIDENCE))
    return F.when(n > 0, conf).otherwise(F.lit(0.0))


def alert_strict(level, conf) -> Column:
    return c(level).isin(*ALERT_LEVELS) & (c(conf) > STRICT_ALERT_CONFIDENCE)


def alert_dashboard(level) -> Column:
    return c(level).isin(*ALERT_LEVELS)


def minmax_inverted(score, lo, hi) -> Column:
    """1 - (s - min)/(max - min) with the *fitted* min/max, clipped to [0, 1];
    0 when the fitted range is flat."""
    rng = c(hi) - c(lo)
    v = 1.0 - (c(score) - c(lo)) / rng
    return F.when(c(score).isNull(), F.lit(None)).when(rng == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def max_scaled(err, mx) -> Column:
    """err / fitted max, clipped to [0, 1]; 0 when the fitted max is 0."""
    v = c(err) / c(mx)
    return F.when(c(err).isNull(), F.lit(None)).when(c(mx) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def row_color(level) -> Column:
    expr = None
    for name, color in ROW_COLORS.items():
        expr = F.when(c(level) == name, color) if expr is None else expr.when(c(level) == name, color)
    return expr.otherwise(DEFAULT_ROW_COLOR)


def alert_banner(level) -> Column:
    return F.when(c(level) == "critical", "CRITICAL ALERT").otherwise("HIGH RISK ALERT")


def predictions_map(names: Sequence[str]) -> Column:
    """model -> probability map column."""
    return F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
