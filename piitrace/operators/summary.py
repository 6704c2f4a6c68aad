"""Roll-ups over scored episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piitrace.functions.scores import GRADE_ORDER, GRADER_EPS, clamp


def _averages():
    """Averages rounded to 9 places, since a distributed sum has no fixed order."""
    return [
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("f1_score"), 9).alias("mean_f1"),
        F.round(F.avg("total_score"), 9).alias("mean_score"),
        F.round(F.stddev_pop("total_score"), 9).alias("std_score"),
    ]


def episode_results(episode_scores: DataFrame) -> DataFrame:
    """Result row per ended episode, rates held to the reporting margin."""
    held = lambda c: clamp(F.col(c), GRADER_EPS)
    return episode_scores.select(
        "episode_id", "difficulty", "strategy", F.col("scenario_id").alias("seed"),
        F.col("step").alias("steps"), held("submit_score").alias("total_score"),
        held("f1_score").alias("f1_score"), held("discovery_rate").alias("discovery_rate"),
        "precision", "grade", F.col("redacted_total").alias("true_positives"),
        (held("f1_score") >= 0.7).alias("success"),
    )


def benchmark_summary(results: DataFrame) -> DataFrame:
    """Mean F1, mean score and population deviation over all runs; 0 for a single run."""
    return results.agg(*_averages())


def benchmark_by(results: DataFrame, by: str = "difficulty") -> DataFrame:
    """The same per ``by`` and over all (``all``) in one pass."""
    out = results.rollup(by).agg(*_averages(), F.grouping(by).alias("_all"))
    return out.withColumn(
        by, F.when(F.col("_all") == 1, "all").otherwise(F.col(by).cast("string"))
    ).drop("_all")


def run_table(results: DataFrame) -> DataFrame:
    """Pass/fail line per run in report order."""
    return results.select(
        "difficulty", "seed", "strategy", "steps", "f1_score", "discovery_rate", "total_score",
        F.when(F.col("success"), "PASS").otherwise("FAIL").alias("status"),
    ).orderBy("difficulty", "seed", "strategy")


def strategy_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("strategy").agg(
        F.round(F.avg("total_score"), 9).alias("mean_score"),
        F.round(F.avg("discovery_rate"), 9).alias("mean_discovery"),
        F.round(F.avg("precision"), 9).alias("mean_precision"),
    )


def best_grade(grade: Column) -> Column:
    """Aggregate: the grade that comes first in S, A, B, C, D, F."""
    rank = F.min(F.instr(F.lit(GRADE_ORDER), F.coalesce(grade, F.lit("F"))))
    return F.substring(F.lit(GRADE_ORDER), rank, F.lit(1))


def kpis(results: DataFrame) -> DataFrame:
    return results.agg(
        F.round(F.avg("f1_score"), 9).alias("avg_f1"),
        F.round(F.avg("discovery_rate"), 9).alias("avg_discovery"),
        best_grade(F.col("grade")).alias("best_grade"),
        F.sum("true_positives").alias("pii_found"),
        F.sum("steps").alias("total_steps"),
    )


def fallback_scores(ends: DataFrame) -> DataFrame:
    """Printed and returned score of a crashed run: mean and sum of its rewards."""
    total = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x)
    n = F.size("rewards")
    return ends.withColumns(
        {
            "printed_score": F.when(n > 0, clamp(total / n, GRADER_EPS)).otherwise(GRADER_EPS),
            "returned_score": F.when(n > 0, clamp(total, GRADER_EPS)).otherwise(GRADER_EPS),
        }
    )


def sorted_set(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """The distinct values per key in sorted order, as rows.

    A range-partitioned sort: the list of a key may span many tasks.
    """
    return df.select(*keys, col).distinct().orderBy(*keys, col)


def next_target(targets: DataFrame, keys: list[str], col: str = "value") -> DataFrame:
    """Smallest target per key: a minimum, so nothing is sorted."""
    return targets.groupBy(*keys).agg(F.min(col).alias("next_target"))


def action_mix(actions: DataFrame, by: list[str]) -> DataFrame:
    """Number of actions per kind and of unknown ones, one column each."""
    kinds = ["scan", "investigate", "redact", "submit"]
    known = F.when(F.col("action_type").isin(kinds), F.col("action_type")).otherwise("rejected")
    return (
        actions.withColumn("_kind", known).groupBy(*by)
        .pivot("_kind", [*kinds, "rejected"]).count()
        .fillna(0, subset=[*kinds, "rejected"])
    )


def trace_total(steps: DataFrame) -> DataFrame:
    """Plain sum of the rewards rounded to 3 places, per episode."""
    return steps.groupBy("episode_id").agg(
        F.round(F.sum(F.bround("reward", 3)), 6).alias("total_reward")
    )
