"""Redaction lists against truth: matches, duplicates, per-step counts and reward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piitrace.functions.scores import ENV_EPS, clamp, ratio
from piitrace.operators.graph import truth_flat

# Per-step redaction weights.
FP_PENALTY = 0.25
FP_CAP = 4
SECRET_BONUS = 0.2


def match_redactions(redactions: DataFrame, truth: DataFrame) -> DataFrame:
    """Each redaction item with ``in_truth`` and ``is_token``.

    ``redactions`` carries scenario_id. A missing original counts as empty text.
    """
    known = truth_flat(truth).withColumnRenamed("value", "original")
    items = redactions.withColumn("original", F.coalesce("original", F.lit("")))
    return (
        items.join(known.withColumn("in_truth", F.lit(True)), ["scenario_id", "original"], "left")
        .withColumns(
            {
                "in_truth": F.coalesce("in_truth", F.lit(False)),
                "is_token": F.coalesce("is_token", F.lit(False)),
            }
        )
    )


def mark_dups(matched: DataFrame) -> DataFrame:
    """Outcome per item over the whole episode: correct, duplicate or false_positive.

    A right item counts at its first place only; a wrong one counts every time.
    The first place is a minimum per (episode, value) joined back, so a value
    repeated without end is never ordered in one task.
    """
    key = ["episode_id", "original"]
    first = matched.filter("in_truth").groupBy(*key).agg(
        F.min(F.struct("step", "pos")).alias("_first")
    )
    is_first = F.struct("step", "pos") == F.col("_first")
    return matched.join(first, key, "left").withColumn(
        "outcome",
        F.when(~F.col("in_truth"), "false_positive").when(is_first, "correct")
        .otherwise("duplicate"),
    ).drop("_first")


def fold_items(items: DataFrame) -> DataFrame:
    """One row per (episode, step, value) with the number ``n`` of its items.

    Done before anything is joined: a value listed without end is shuffled as one
    row per map task, and no join feeds a grouping by its own keys, which would keep
    Spark from splitting a hot key.
    """
    return items.withColumn("original", F.coalesce("original", F.lit(""))).groupBy(
        "episode_id", "step", "original"
    ).agg(F.count(F.lit(1)).alias("n"))


def redact_counts(folded: DataFrame) -> DataFrame:
    """Correct / false positive / duplicate counts and new secrets per step.

    ``folded`` has one row per (episode, step, value) with ``n`` and the truth
    flags; the window orders at most one row per step.
    """
    first_step = F.min("step").over(Window.partitionBy("episode_id", "original"))
    right = F.col("in_truth")
    fresh = (right & (F.col("step") == F.col("first_step"))).cast("bigint")
    return (
        folded.withColumn("first_step", first_step)
        .groupBy("episode_id", "step")
        .agg(
            F.sum(fresh).alias("correct"),
            F.sum(F.when(~right, F.col("n")).otherwise(0)).alias("false_positives"),
            F.sum(F.when(right, F.col("n") - fresh).otherwise(0)).alias("duplicates"),
            F.sum(F.when(F.col("is_token"), fresh).otherwise(0)).alias("secrets_redacted"),
        )
    )


def redacted_at(matched: DataFrame) -> DataFrame:
    """Step at which each true value entered the redacted set."""
    return matched.filter("in_truth").groupBy(
        "episode_id", "scenario_id", F.col("original").alias("value")
    ).agg(F.min("step").alias("redacted_at"), F.max("is_token").alias("is_token"))


def redact_parts(correct: Column, fp: Column, secrets: Column, total: Column) -> dict[str, Column]:
    """The named parts of a redact step's reward."""
    score = clamp(ratio(correct, total), ENV_EPS)
    penalty = F.lit(-FP_PENALTY) * F.least(fp, F.lit(FP_CAP)).cast("double")
    bonus = F.when(secrets > 0, clamp(F.lit(SECRET_BONUS) * secrets, ENV_EPS)).otherwise(
        F.lit(ENV_EPS)
    )
    return {
        "redaction_score": score,
        "penalty": penalty,
        "secret_bonus": bonus,
        "redact_reward": clamp(score + penalty + bonus, ENV_EPS),
    }


def redact_reward(correct: Column, fp: Column, dups: Column, secrets: Column,
                  total: Column) -> Column:
    """Reward of a redact step; an empty list earns the margin only."""
    empty = (correct + fp + dups) == 0
    full = redact_parts(correct, fp, secrets, total)["redact_reward"]
    return F.when(empty, F.lit(ENV_EPS)).otherwise(full)


def coverage(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Running share of the truth redacted after each step.

    ``counts`` has episode_id, scenario_id, step, correct; one row per live step.
    """
    so_far = Window.partitionBy("episode_id").orderBy("step").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return counts.join(totals, "scenario_id").withColumns(
        {"redacted_total": F.sum("correct").over(so_far)}
    ).withColumn("coverage", clamp(ratio(F.col("redacted_total"), F.col("total_pii")), ENV_EPS))
