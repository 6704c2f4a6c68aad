"""Confusion counts, rates, the two episode scores and the bounds audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piitrace.functions.scores import (
    ENV_EPS,
    GRADER_EPS,
    NEUTRAL,
    clamp,
    f1_of,
    fixed,
    letter_grade,
    percent,
    ratio,
)

# Weights of the two scores.
F1_WEIGHT, DISCOVERY_WEIGHT, RECALL_WEIGHT = 0.7, 0.2, 0.1
STEP_SAVED_BONUS = 0.05
ENV_SECRET, ENV_SECRET_CAP = 0.3, 3
GRADER_SECRET = 0.2
GRADER_SCORES = [
    "precision", "recall", "f1_score", "discovery_rate", "efficiency", "f1_component",
    "discovery_component", "recall_component", "efficiency_bonus", "total_score",
]


def confusion(pred: DataFrame, truth: DataFrame, case: list[str]) -> DataFrame:
    """TP / FP / FN per case from rows (case..., value); both sides are sets.

    A union with two flags and one aggregate instead of a full outer join: the
    combine runs before the shuffle and a case may be of any size.
    """
    mark = lambda df, p, t: df.select(
        *case, "value", F.lit(p).alias("p"), F.lit(t).alias("t")
    )
    sets = mark(pred, 1, 0).unionByName(mark(truth, 0, 1)).groupBy(*case, "value").agg(
        F.max("p").alias("p"), F.max("t").alias("t")
    )
    p, t = F.col("p") == 1, F.col("t") == 1
    return sets.groupBy(*case).agg(
        F.count(F.when(p & t, 1)).alias("true_positives"),
        F.count(F.when(p & ~t, 1)).alias("false_positives"),
        F.count(F.when(~p & t, 1)).alias("false_negatives"),
    )


def grader_counts(cases: DataFrame, redacted: DataFrame, truth: DataFrame,
                  discovered: DataFrame, secrets: DataFrame, case: list[str]) -> DataFrame:
    """All set counts the grader needs, per case, in one aggregate over flagged rows.

    ``cases`` has one row per case with steps_used and steps_budget; the four
    sets are rows (case..., value) and may be empty for a case.
    """
    names = ["r", "t", "d", "s"]

    def mark(df, on):
        return df.select(
            *case, "value", *[F.lit(1 if n == on else 0).alias(n) for n in names]
        )

    rows = reduce(
        DataFrame.unionByName,
        [mark(df, n) for df, n in zip([redacted, truth, discovered, secrets], names)],
    )
    sets = rows.groupBy(*case, "value").agg(*[F.max(n).alias(n) for n in names])
    r, t, d, s = [F.col(n) == 1 for n in names]
    n_of = lambda test, name: F.count(F.when(test, 1)).alias(name)
    counts = sets.groupBy(*case).agg(
        n_of(r & t, "true_positives"), n_of(r & ~t, "false_positives"),
        n_of(~r & t, "false_negatives"), n_of(d & t, "discovered_count"),
        n_of(s & r, "secrets_found"), n_of(s & ~r, "secrets_missed"),
        n_of(s, "secrets_total"), n_of(t, "total_pii"),
    )
    zero = [c for c in counts.columns if c not in case]
    return cases.join(counts, case, "left").fillna(0, subset=zero)


def discovered_correct(discovered: DataFrame, truth: DataFrame, case: list[str],
                       shared: list[str] | None = None) -> DataFrame:
    """Discovered true values per case. ``shared`` names the columns that tie a truth to its cases,
    so that a truth many cases share is stated once; the case itself if left out."""
    on = [*(case if shared is None else shared), "value"]
    return (
        discovered.select(*dict.fromkeys([*case, *on])).distinct()
        .join(truth.select(*on), on, "left_semi")
        .groupBy(*case).agg(F.count(F.lit(1)).alias("discovered_correct"))
    )


def secret_counts(secrets: DataFrame, redacted: DataFrame, case: list[str]) -> DataFrame:
    keys = [*case, "value"]
    hit = redacted.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return secrets.select(*keys).distinct().join(hit, keys, "left").groupBy(*case).agg(
        F.count("_hit").alias("secrets_found"),
        F.count(F.when(F.col("_hit").isNull(), 1)).alias("secrets_missed"),
        F.count(F.lit(1)).alias("secrets_total"),
    )


def prf(df: DataFrame, eps: float) -> DataFrame:
    """precision, recall and f1_score; F1 from the clamped rates."""
    tp, fp, total = F.col("true_positives"), F.col("false_positives"), F.col("total_pii")
    out = df.withColumns(
        {
            "precision": clamp(ratio(tp, tp + fp), eps),
            "recall": clamp(ratio(tp, total), eps),
        }
    )
    return out.withColumn("f1_score", f1_of(F.col("precision"), F.col("recall"), eps))


def discovery_rate(discovered: Column, total: Column, eps: float) -> Column:
    return clamp(ratio(discovered, total), eps)


def steps_saved(budget: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), budget - used)


def eff_env(budget: Column, used: Column) -> Column:
    """0.05 per step saved, clamped; none saved earns the margin."""
    return clamp(F.lit(STEP_SAVED_BONUS) * steps_saved(budget, used), ENV_EPS)


#: Why a case cannot be graded.
BAD_BUDGET = "steps_budget must be positive"


def eff_grader(budget: Column, used: Column, strict: bool = True) -> Column:
    """Share of the budget saved, clamped. A budget must be positive: another one ends the job or, if
    not ``strict``, has no efficiency."""
    share = steps_saved(budget, used).cast("double") / budget.cast("double")
    if strict:
        return clamp(F.when(budget > 0, share).otherwise(
            F.raise_error(F.lit(BAD_BUDGET)).cast("double")), GRADER_EPS)
    return F.when(budget > 0, clamp(share, GRADER_EPS))


def secret_penalty(missed: Column, profile: str) -> Column:
    if profile == "env":
        return F.lit(-ENV_SECRET) * F.least(missed, F.lit(ENV_SECRET_CAP)).cast("double")
    if profile == "grader":
        return F.lit(-GRADER_SECRET) * missed.cast("double")
    raise ValueError(f"profile must be env or grader, not {profile!r}")


def env_parts(redacted: Column, discovered: Column, total: Column, missed: Column,
              budget: Column, used: Column) -> dict[str, Column]:
    """Parts of the submit score from the as-of counts of an episode.

    Wrong items never enter the redacted set, so precision is 1 (clamped) as
    soon as anything is redacted. Terms are added left to right.
    """
    precision = F.when(redacted > 0, F.lit(1.0 - ENV_EPS)).otherwise(F.lit(ENV_EPS))
    recall = clamp(ratio(redacted, total), ENV_EPS)
    f1 = f1_of(precision, recall, ENV_EPS)
    rate = discovery_rate(discovered, total, ENV_EPS)
    bonus = eff_env(budget, used)
    penalty = secret_penalty(missed, "env")
    raw = (
        f1 * F.lit(F1_WEIGHT) + rate * F.lit(DISCOVERY_WEIGHT) + recall * F.lit(RECALL_WEIGHT)
        + bonus + penalty
    )
    return {
        "precision": precision, "recall": recall, "f1_score": f1, "discovery_rate": rate,
        "efficiency_bonus": bonus, "penalty": penalty, "total_score": clamp(raw, ENV_EPS),
        "redaction_score": clamp(
            f1 * F.lit(F1_WEIGHT) + recall * F.lit(RECALL_WEIGHT), ENV_EPS
        ),
        "discovery_bonus": clamp(rate * F.lit(DISCOVERY_WEIGHT), ENV_EPS),
    }


def score_env(df: DataFrame) -> DataFrame:
    """Submit metrics per episode from redacted_total, discovered_truth, total_pii,
    secrets_missed, budget and steps_used."""
    n = F.col
    out = df.withColumns(
        env_parts(n("redacted_total"), n("discovered_truth"), n("total_pii"),
                  n("secrets_missed"), n("budget"), n("steps_used"))
    )
    return out.withColumns(
        {
            "true_positives": n("redacted_total"),
            "false_positives": F.lit(0).cast("bigint"),
            "false_negatives": n("total_pii") - n("redacted_total"),
            "steps_budget": n("budget"),
            "grade": letter_grade(n("total_score")),
        }
    )


def score_grader(counts: DataFrame, strict: bool = True) -> DataFrame:
    """Grader metrics per case; a case without truth gets the neutral row.

    A budget that is not positive ends the job. If not ``strict``, such a case gets no scores and no grade,
    and a column ``rejected`` says why; it is null for all others.
    """
    n = F.col
    if not strict:
        bad = ~F.coalesce(n("steps_budget") > 0, F.lit(False))
        held = counts.withColumns({"_budget": n("steps_budget"), "steps_budget": F.when(bad, 1).otherwise(
            n("steps_budget"))})
        scored = score_grader(held).withColumns(
            {"rejected": F.when(n("_budget").isNull() | (n("_budget") <= 0), BAD_BUDGET), "steps_budget": n("_budget")})
        gone = {c: F.when(n("rejected").isNull(), n(c)) for c in (*GRADER_SCORES, "steps_saved", "grade")}
        return scored.withColumns(gone).drop("_budget")
    empty = n("total_pii") == 0
    out = prf(counts, GRADER_EPS)
    out = out.withColumns(
        {
            "discovery_rate": discovery_rate(n("discovered_count"), n("total_pii"), GRADER_EPS),
            "steps_saved": steps_saved(n("steps_budget"), n("steps_used")),
            "efficiency": eff_grader(n("steps_budget"), n("steps_used")),
        }
    )
    out = out.withColumns(
        {
            "f1_component": clamp(n("f1_score") * F1_WEIGHT, GRADER_EPS),
            "discovery_component": clamp(n("discovery_rate") * DISCOVERY_WEIGHT, GRADER_EPS),
            "recall_component": clamp(n("recall") * RECALL_WEIGHT, GRADER_EPS),
            "efficiency_bonus": clamp(n("efficiency") * STEP_SAVED_BONUS, GRADER_EPS),
        }
    )
    raw = (
        n("f1_component") + n("discovery_component") + n("recall_component")
        + n("efficiency_bonus") + secret_penalty(n("secrets_missed"), "grader")
    )
    out = out.withColumn("total_score", clamp(raw, GRADER_EPS))
    out = out.withColumns(
        {c: F.when(empty, F.lit(NEUTRAL)).otherwise(n(c)) for c in GRADER_SCORES}
    )
    counted = ["discovered_count", "secrets_found", "secrets_missed", "secrets_total",
               "true_positives", "false_positives", "false_negatives"]
    out = out.withColumns(
        {c: F.when(empty, F.lit(0).cast("bigint")).otherwise(n(c)) for c in counted}
    )
    return out.withColumn("grade", letter_grade(n("total_score")))


def explode_cases(df: DataFrame) -> dict[str, DataFrame]:
    """Grader input rows with array columns to the five row tables of ``grader_counts``."""
    rows = lambda c: df.select("case_id", F.explode(c).alias("value"))
    return {
        "cases": df.select("case_id", "steps_used", "steps_budget"),
        "redacted": rows("redacted"),
        "truth": rows("ground_truth"),
        "discovered": rows("discovered"),
        "secrets": rows("secret_tokens"),
    }


def grader_feedback(df: DataFrame) -> DataFrame:
    """One text per graded case: grade, F1 band, discovery band, secrets, steps saved."""
    f1, rate = F.col("f1_score"), F.col("discovery_rate")
    share = percent(rate)
    missed, total, saved = F.col("secrets_missed"), F.col("secrets_total"), F.col("steps_saved")
    parts = [
        F.concat(F.lit("Grade: "), F.col("grade"), F.lit(" ("),
                 percent(F.col("total_score"), 1), F.lit(")")),
        F.concat(
            F.lit("Redaction accuracy: "),
            F.when(f1 >= 0.95, "Outstanding.")
            .when(f1 >= 0.80, "Strong. Minor improvements possible.")
            .when(f1 >= 0.60, "Moderate. Missed several items.")
            .otherwise("Needs significant improvement."),
        ),
        F.concat(
            F.lit("Investigation depth: "),
            F.when(rate < 0.5, F.concat(F.lit("Shallow ("), share,
                                        F.lit("). Explore more entities.")))
            .when(rate < 0.8, F.concat(F.lit("Moderate ("), share, F.lit("). Go deeper.")))
            .otherwise(F.concat(F.lit("Thorough ("), share, F.lit(")."))),
        ),
        F.when(missed > 0, F.concat(F.lit("⚠️ CRITICAL: "), missed.cast("string"),
                                    F.lit(" secret(s) missed! Heavy penalty applied.")))
        .when(total > 0, F.concat(F.lit("✅ All "), total.cast("string"),
                                  F.lit(" secret(s) found and redacted."))),
        F.when(saved > 2, F.concat(F.lit("Efficient: "), saved.cast("string"),
                                   F.lit(" steps saved (bonus applied)."))),
    ]
    return df.withColumn("feedback", F.concat_ws(" | ", *parts))


def audit_bounds(df: DataFrame, score_cols: list[str], eps: float,
                 forbidden: tuple[str, ...] = ("secret_penalty",)) -> DataFrame:
    """Per score column: rows, rows outside [eps, 1-eps], smallest and largest value.

    Raises if a column that must stay internal is present.
    """
    leaked = [c for c in forbidden if c in df.columns]
    if leaked:
        raise ValueError(f"internal columns exposed: {leaked}")
    stacked = df.select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("score"))
            for c in score_cols
        ]))
    )
    out = F.col("score").isNull() | ~F.col("score").between(eps, 1.0 - eps)
    return stacked.groupBy("field").agg(
        F.count(F.lit(1)).alias("checked"),
        F.count(F.when(out, 1)).alias("out_of_bounds"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def score_text(score: Column) -> Column:
    return fixed(score, 3)
