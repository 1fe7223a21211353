"""Rule-based scoring: segments, churn scores, risk bands, advice, CLV.

All operators add columns to any frame carrying the named inputs; they are
pure projections (no shuffle) and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions import as_col, clamp, dbl, half_even, js_round, safe_ratio
from spendlens.functions import labels as L


# ----------------------------------------------------------------- segments
# FIXED VALUES – the segment rules, in the order they are tried.
def segment_expr(recency="recency", frequency="frequency") -> Column:
    """RFM segment label; the rules are tried in this order."""
    r, f = as_col(recency), as_col(frequency)
    return (F.when((f >= 8) & (r <= 30), L.CHAMPIONS)
             .when((f >= 4) & (r <= 60), L.LOYALISTS)
             .when((f >= 2) & (r <= 45), L.POTENTIAL)
             .when((r > 120) & (f >= 3), L.AT_RISK)
             .when(r > 180, L.HIBERNATING)
             .when((r <= 30) & (f == 1), L.NEW_CUSTOMERS)
             .otherwise(L.NEED_ATTENTION))


def assign_segment(df: DataFrame, recency: str = "recency", frequency: str = "frequency",
                   out: str = "segment") -> DataFrame:
    return df.withColumn(out, segment_expr(recency, frequency))


# ------------------------------------------------------------ churn scores
# FIXED VALUES – the weights of the heuristic.
def churn_heuristic_expr(recency="recency", tickets="support_tickets", frequency="frequency",
                         satisfaction="satisfaction_rating") -> Column:
    """0.35 r + 8 tickets - 4.5 f + 12 (5 - satisfaction), clamped to [0, 100]
    and rounded half up to a whole number."""
    raw = (dbl(recency) * 0.35 + dbl(tickets) * 8.0 - dbl(frequency) * 4.5
           + (F.lit(5) - as_col(satisfaction)) * 12.0)
    return js_round(clamp(raw, 0.0, 100.0), 0)


def churn_heuristic(df: DataFrame, out: str = "churn_risk", **cols) -> DataFrame:
    return df.withColumn(out, churn_heuristic_expr(**cols))


# Logistic churn score: centre, scale and weight of each input (fixed values).
LOGISTIC_INTERCEPT = -0.5
LOGISTIC_TERMS = [
    # (input column, centre, divisor, weight)
    ("recency", 40.0, 40.0, 1.8),
    ("frequency", 4.0, 4.0, -1.5),
    ("avg_order_value", 120.0, 100.0, -0.5),
    ("support_tickets", 1.0, 1.0, 1.1),
    ("discount_usage", 25.0, 25.0, 0.4),
    ("satisfaction", 4.0, 1.0, -2.2),
]


def logistic_log_odds(**names) -> Column:
    z = F.lit(LOGISTIC_INTERCEPT)
    for col, centre, div, weight in LOGISTIC_TERMS:
        term = (dbl(names.get(col, col)) - F.lit(centre)) / F.lit(div) * F.lit(weight)
        z = z + term
    return z


def churn_logistic_score(df: DataFrame, **names) -> DataFrame:
    """Batch churn probability: ``round(100 * sigmoid(z))`` with the fixed
    weights above, and ``is_high_risk`` (probability >= 50)."""
    z = logistic_log_odds(**names)
    prob = js_round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) * F.lit(100.0), 0)
    return (df.withColumn("churn_probability", prob)
              .withColumn("is_high_risk", F.col("churn_probability") >= 50))


# FIXED VALUES – the thresholds of the four bands.
def risk_bands(df: DataFrame, recency="recency", frequency="frequency",
               tickets="support_tickets", satisfaction="satisfaction", as_struct: bool = False) -> DataFrame:
    """Four risk factors (high / medium / low) as flat columns, or as one
    ``risk_factor_breakdown`` struct with ``as_struct=True``."""
    r, f, t, s = (as_col(x) for x in (recency, frequency, tickets, satisfaction))
    bands = {
        "recency_factor": F.when(r > 90, L.HIGH).when(r > 30, L.MEDIUM).otherwise(L.LOW),
        "frequency_factor": F.when(f <= 1, L.HIGH).when(f <= 3, L.MEDIUM).otherwise(L.LOW),
        "support_factor": F.when(t >= 3, L.HIGH).when(t >= 1, L.MEDIUM).otherwise(L.LOW),
        "satisfaction_factor": F.when(s <= 2, L.HIGH).when(s <= 3, L.MEDIUM).otherwise(L.LOW),
    }
    if as_struct:
        return df.withColumn("risk_factor_breakdown", F.struct(*[c.alias(n) for n, c in bands.items()]))
    return df.withColumns(bands)


# FIXED VALUES – the thresholds of the advice rules.
def churn_actions(df: DataFrame, recency="recency", frequency="frequency", tickets="support_tickets",
                  discount="discount_usage", satisfaction="satisfaction",
                  out: str = "recommendations") -> DataFrame:
    """Array of advice codes, in rule order; the newsletter when none applies."""
    r, f, t, d, s = (as_col(x) for x in (recency, frequency, tickets, discount, satisfaction))
    picks = F.array_compact(F.array(
        F.when(r > 45, F.when(d > 40, L.REACTIVATION_25).otherwise(L.REACTIVATION_15)),
        F.when(s <= 3, L.CX_CALL),
        F.when(f == 1, L.SECOND_PURCHASE),
        F.when(t > 2, L.SUPPORT_CREDIT),
    ))
    return df.withColumn(out, F.when(F.size(picks) == 0, F.array(F.lit(L.NEWSLETTER))).otherwise(picks))


# FIXED VALUES – the probability thresholds.
def retention_action_expr(probability="churn_risk_probability") -> Column:
    p = dbl(probability)
    return (F.when(p >= 85.0, L.ACTION_CRITICAL)
             .when(p >= 60.0, L.ACTION_WARNING)
             .otherwise(L.ACTION_STABLE))


def retention_action(df: DataFrame, probability: str = "churn_risk_probability",
                     out: str = "retention_action") -> DataFrame:
    return df.withColumn(out, retention_action_expr(probability))


# ---------------------------------------------------------------------- CLV
def clv_discounted(rfm: DataFrame, retention: float = 0.82, discount: float = 0.10,
                   margin: float = 0.15, monetary: str = "monetary",
                   frequency: str = "frequency") -> DataFrame:
    """monetary * margin * retention / (1 + discount - retention), rounded
    half-even to cents; also the average order value ``aov`` (the whole spend
    where a customer has no order)."""
    factor = retention / (1 + discount - retention)
    return (rfm.withColumn("aov", safe_ratio(monetary, frequency))
               .withColumn("clv_estimate", half_even(dbl(monetary) * F.lit(margin) * F.lit(factor), 2)))


def clv_multiplier_expr(monetary="monetary", frequency="frequency", factor: float = 1.82) -> Column:
    aov = safe_ratio(monetary, frequency)
    return js_round(aov * dbl(frequency) * F.lit(factor), 2)


def clv_multiplier(df: DataFrame, factor: float = 1.82, out: str = "clv") -> DataFrame:
    """average order value * frequency * factor, rounded half up to cents."""
    return df.withColumn(out, clv_multiplier_expr(factor=factor))


def churn_label(rfm: DataFrame, threshold: int = 90, recency: str = "recency") -> DataFrame:
    """1 when the customer has been away longer than ``threshold`` days."""
    return rfm.withColumn("churn_label", (as_col(recency) > threshold).cast("int"))
