"""Iterative plans over many scenarios at once.

Both go on until a round finds nothing new, which takes as many rounds as things wait for one
another. Each round is one set of joins for all scenarios or episodes; between rounds what it found is
written to the shared folder, so lineage does not grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piitrace.plans.replay import BY_STEP, largest_budget, log_classes
from piitrace.session import cut, drop


def _hidden_values(logs: DataFrame) -> DataFrame:
    """Value to label set of the hidden line classes it occurs in."""
    return log_classes(logs).filter("n_hidden > 0").select(
        "scenario_id", F.explode("labels").alias("value"), "labels"
    )


def _surface_values(logs: DataFrame) -> DataFrame:
    return logs.filter("layer = 0").select(
        "scenario_id", F.inline("labels")
    ).select("scenario_id", "value").distinct()


def _found(moves: DataFrame, edges: DataFrame, hidden: DataFrame, keys: list[str]) -> DataFrame:
    """Values on lines revealed by investigating ``target``: (keys..., value)."""
    out = edges.withColumnRenamed("src", "target")
    search = (
        moves.join(out, ["scenario_id", "target"], "left")
        .select(*keys, F.explode(F.array_compact(F.array("target", "dst"))).alias("value"))
        .distinct()
    )
    return search.join(hidden, ["scenario_id", "value"]).select(
        *keys, F.explode("labels").alias("value")
    ).distinct()


def reachable(logs: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Values an unlimited investigator knows, with the round each is first reached (0: on the
    surface). Only new values are expanded. Goes on until a round finds nothing new, or
    for ``rounds`` rounds if that is given."""
    hidden = cut(_hidden_values(logs), "hidden")
    keys = ["scenario_id", "value"]
    known = frontier = cut(_surface_values(logs).withColumn("reached", F.lit(0)), "reach")
    k = 0
    while rounds is None or k < rounds:
        k += 1
        moves = frontier.select("scenario_id", F.col("value").alias("target"))
        # Only what a round finds is written; what was known stays where it is.
        frontier = cut(_found(moves, edges, hidden, ["scenario_id"]).join(known, keys, "left_anti").withColumn(
            "reached", F.lit(k)), "reach")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def apply_driver_rules(plan: DataFrame, scenarios: DataFrame, logs: DataFrame, edges: DataFrame,
                       honeypots: DataFrame) -> DataFrame:
    """Planned decisions to the actions a run would take.

    Decisions count from 1 in the order of their recorded steps. Step 1 is a scan. A
    step with one step left is a submit. An investigation whose target is missing, not
    discovered by then or already investigated becomes a scan.

    A value is tried at the first step that asks for it after it is known; it is known from the
    first step at which one that reveals it is tried. Both only move to earlier steps as more
    is found out, so the steps are the least fixed point: a round hands on what the last one
    moved, and there are as many rounds as values that wait for one another, not as many as steps. The state
    holds only values that a plan asks for, what reveals what is worked out once a scenario.
    """
    episode = ["episode_id", "scenario_id"]
    top = largest_budget(scenarios)
    by_step = Window.partitionBy("episode_id").orderBy(*BY_STEP)
    plan = plan.withColumn("step", F.row_number().over(by_step)).filter(F.col("step") <= top).join(
        scenarios.select("scenario_id", "budget"), "scenario_id"
    ).filter(F.col("step") <= F.col("budget"))
    opening = F.when(F.col("step") == 1, "scan").when(
        F.col("step") == F.col("budget"), "submit"
    )
    plan = plan.withColumn("planned", F.coalesce(opening, F.col("action_type")))
    ends = plan.groupBy("episode_id").agg(
        F.min(F.when(F.col("planned") == "submit", F.col("step"))).alias("_end")
    )
    plan = cut(
        plan.join(ends, "episode_id").filter(F.col("step") <= F.coalesce("_end", "step")).drop(
            "_end"),
        "plan",
    )
    hidden = cut(_hidden_values(logs), "hidden")
    traps = honeypots.select("scenario_id", F.col("value").alias("target"))
    asked = plan.filter("planned = 'investigate' and target_entity is not null").select(
        *episode, "step", F.col("target_entity").alias("value"))
    wanted = asked.select("scenario_id", "value").distinct()
    safe = wanted.withColumnRenamed("value", "target").join(traps, ["scenario_id", "target"], "left_anti")
    links = cut(_found(safe, edges, hidden, ["scenario_id", "target"]).join(
        wanted, ["scenario_id", "value"], "left_semi"), "links")
    # An episode asks for a value at most as often as it has steps.
    surface = _surface_values(logs).withColumn("known", F.lit(0))
    first = F.array_min(F.filter("steps", lambda x: x > F.col("known")))
    state = asked.groupBy(*episode, "value").agg(F.collect_set("step").alias("steps")).join(
        surface, ["scenario_id", "value"], "left")
    state = cut(state.withColumn("tried", first).withColumn("moved", F.col("tried").isNotNull()), "driver")
    while not state.filter("moved").isEmpty():
        handed = state.filter("moved").select(*episode, F.col("value").alias("target"), "tried").join(
            links, ["scenario_id", "target"]).groupBy(*episode, "value").agg(F.min("tried").alias("told"))
        before, state = state, state.join(handed, [*episode, "value"], "left").withColumns(
            {"known": F.least("known", "told"), "was": F.col("tried")}).withColumn("tried", first)
        state = cut(state.withColumn("moved", ~F.col("tried").eqNullSafe(F.col("was"))).drop("told", "was"), "driver")
        drop(before)
    valid = state.filter("tried is not null").select(
        "episode_id", F.col("value").alias("target_entity"), F.col("tried").alias("step"),
        F.lit(True).alias("_valid"),
    )
    act = F.when(
        (F.col("planned") == "investigate") & F.col("_valid").isNull(), "scan"
    ).otherwise(F.col("planned"))
    out = plan.join(valid, ["episode_id", "target_entity", "step"], "left").withColumn("act", act)
    return out.select(
        *episode, "strategy", "step", F.col("act").alias("action_type"),
        F.when(F.col("act") == "investigate", F.col("target_entity")).alias("target_entity"),
        F.col("action_type").alias("planned_type"),
    )
