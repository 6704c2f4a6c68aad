"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clamp margins, grade floors, reward weights.
ENV_EPS = 0.05
GRADER_EPS = 0.01
NEUTRAL = 0.5
GRADE_FLOORS = [("S", 0.95), ("A", 0.85), ("B", 0.70), ("C", 0.50), ("D", 0.30)]
GRADE_ORDER = "SABCDF"
SUCCESS_F1 = 0.70
CLAMPED_COMPONENTS = ["redaction_score", "discovery_bonus", "efficiency_bonus"]
CLAMPED_METRICS = [
    "precision", "recall", "f1_score", "discovery_rate", "efficiency", "f1_component",
    "discovery_component", "recall_component", "efficiency_bonus", "total_score", "coverage",
]


def clamp(c: Column, eps: float) -> Column:
    """Hold ``c`` in [eps, 1-eps]; null becomes eps.

    The null test is on the input: ``greatest``/``least`` skip nulls, so without
    it a null would come out as 1-eps.
    """
    value = F.coalesce(c.cast("double"), F.lit(eps))
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), value))


def ratio(num: Column, den: Column) -> Column:
    """num/den as double, null where den is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def letter_grade(score: Column) -> Column:
    out = None
    for grade, floor in GRADE_FLOORS:
        test = score >= F.lit(floor)
        out = F.when(test, grade) if out is None else out.when(test, grade)
    return out.otherwise("F")


def success(f1: Column) -> Column:
    return F.coalesce(f1 >= F.lit(SUCCESS_F1), F.lit(False))


def f1_of(precision: Column, recall: Column, eps: float) -> Column:
    """Harmonic mean of two already clamped rates, clamped again."""
    return clamp(F.lit(2.0) * precision * recall / (precision + recall), eps)


def clamped_fold(rewards: Column, eps: float = ENV_EPS) -> Column:
    """Start at eps, add each reward in turn, clamp after every addition."""
    return F.aggregate(rewards, F.lit(eps), lambda acc, x: clamp(acc + x, eps))


def fixed(c: Column, places: int) -> Column:
    """Text of ``c`` with ``places`` decimals, exact ties to the even digit."""
    return F.format_string(f"%.{places}f", F.bround(c, places))


def percent(c: Column, places: int = 0) -> Column:
    return F.concat(fixed(c * F.lit(100.0), places), F.lit("%"))


def coverage_text(n: Column, total: Column) -> Column:
    """``n/total (p%)``; an empty total counts as 0 percent."""
    share = F.coalesce(ratio(n, total), F.lit(0.0))
    return F.concat(n.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), percent(share),
                    F.lit(")"))


def reward_components(df):
    """Clamp the three component columns and derive ``score`` from ``total_reward``.

    ``penalty`` and ``total_reward`` may be negative and stay as they are.
    ``metrics`` is a MAP<STRING, DOUBLE>; only the named score keys are clamped.
    """
    out = df.withColumns({c: clamp(F.col(c), ENV_EPS) for c in CLAMPED_COMPONENTS})
    out = out.withColumn("score", clamp(F.col("total_reward"), ENV_EPS))
    return out.withColumn(
        "metrics",
        F.transform_values(
            "metrics",
            lambda k, v: F.when(k.isin(CLAMPED_METRICS), clamp(v, ENV_EPS)).otherwise(v),
        ),
    )


def rounded_trace(df, reward_col: str = "reward", metric_cols=()):
    """Step rewards to 3 places, final metrics to 6."""
    cols = {reward_col: F.bround(F.col(reward_col), 3)}
    cols.update({c: F.bround(F.col(c), 6) for c in metric_cols})
    return df.withColumns(cols)
