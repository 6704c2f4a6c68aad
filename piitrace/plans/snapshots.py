"""What an episode's observation holds at any step, without a row per value and step.

A value belongs to the observation from one step to another; ``spans`` has one row for each such
stretch, from step 0, the state right after reset. Steps asked about meet them in buckets of
``WIDTH`` steps, so that a long episode neither unrolls its values nor compares every span with every step asked.

Defined results: steps are those of ``Replay.live``; a span ends with the last of them; steps asked about
beyond it, or null ones, show nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piitrace.functions.entities import classify_env
from piitrace.functions.scores import ENV_EPS
from piitrace.plans.replay import EPISODE, Replay, end_flags, entity_spans, step_feedback, visible_at

KINDS = ("discovered", "target", "redacted", "visible_log")
#: Steps of a bucket.
WIDTH = 8


def spans(replay: Replay, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(episode, kind, value, pii_type, from_step, to_step). Values of log lines are their ids, without a type.

    ``discovered`` are the scan results of an observation, ``target`` those not yet investigated,
    ``redacted`` its redactions.
    """
    c = F.col
    ends = end_flags(replay.live).select("episode_id", "steps_used")
    parts = []

    def part(rows: DataFrame, kind: str, start: str, stop) -> None:
        parts.append(rows.join(ends, "episode_id").select(
            *EPISODE, F.lit(kind).alias("kind"), "value", c(start).cast("int").alias("from_step"),
            stop.cast("int").alias("to_step")).where("from_step <= to_step"))

    used = c("steps_used")
    found = entity_spans(replay)
    if "discovered" in kinds:
        part(found, "discovered", "discovered_at", used)
    if "target" in kinds:
        part(found, "target", "discovered_at", F.least(c("investigated_at") - 1, used))
    if "redacted" in kinds:
        part(replay.redacted_at, "redacted", "redacted_at", used)
    typed = None
    for p in parts:
        typed = p if typed is None else typed.unionByName(p)
    columns = ["episode_id", "kind", "value", "pii_type", "from_step", "to_step"]
    if typed is not None:
        typed = classify_env(typed, replay.truth).withColumnRenamed("entity_class", "pii_type").select(*columns)
    if "visible_log" in kinds:
        parts.clear()
        part(visible_at(replay.live, replay.logs, replay.edges).withColumn("value", c("log_id").cast("string")),
             "visible_log", "visible_at", used)
        lines = parts[0].withColumn("pii_type", F.lit(None).cast("string")).select(*columns)
        typed = lines if typed is None else typed.unionByName(lines)
    return typed


def at_steps(all_spans: DataFrame, asked: DataFrame, width: int = WIDTH) -> DataFrame:
    """The items (episode, step, kind, value, pii_type) of the observations asked about, by rows
    (episode_id, step) of ``asked``."""
    c = F.col
    bucket = lambda x: F.floor(c(x) / width).cast("int")
    dealt = all_spans.withColumn("bucket", F.explode(F.sequence(bucket("from_step"), bucket("to_step"))))
    wanted = asked.select("episode_id", c("step").cast("int").alias("step")).where(
        "step >= 0").distinct().withColumn("bucket", bucket("step"))
    return wanted.join(dealt, ["episode_id", "bucket"]).where("step between from_step and to_step").select(
        "episode_id", "step", "kind", "value", "pii_type")


def heads(replay: Replay) -> DataFrame:
    """The counts and texts of every observation, from the one after reset (step 0) to the last."""
    c = F.col
    steps = replay.step_results
    after = steps.join(step_feedback(replay).select("episode_id", "step", "hint"), ["episode_id", "step"]).select(
        "episode_id", "step", "visible_total", "discovered_total", c("redacted_total").alias("pii_found_count"),
        c("total_pii").alias("total_pii_to_find"), "steps_remaining", "difficulty",
        c("cumulative_reward").alias("score_so_far"), "hint")
    first = replay.live.where("step = 1").select(*EPISODE, "budget", "difficulty", "n_layers")
    surface = replay.logs.where("layer = 0").groupBy("scenario_id").agg(F.count("*").alias("visible_total"))
    total = replay.truth.groupBy("scenario_id").agg(F.count_distinct("value").alias("total_pii_to_find"))
    none = F.lit(0).cast("bigint")
    # Fixed value: the hint after reset.
    hint = F.concat(
        F.lit("You're investigating a potential data breach. "), c("total_pii_to_find").cast("string"),
        F.lit(" PII items are hidden across "), c("n_layers").cast("string"),
        F.lit(" layers. Start by scanning the visible logs."))
    reset = first.join(surface, "scenario_id", "left").join(total, "scenario_id", "left").withColumns({
        "total_pii_to_find": F.coalesce("total_pii_to_find", none),
        "visible_total": F.coalesce("visible_total", none)}).select(
        "episode_id", F.lit(0).alias("step"), "visible_total", none.alias("discovered_total"),
        none.alias("pii_found_count"), "total_pii_to_find", c("budget").cast("int").alias("steps_remaining"),
        "difficulty", F.lit(ENV_EPS).alias("score_so_far"), hint.alias("hint"))
    return after.unionByName(reset)


def trace_lines(replay: Replay) -> DataFrame:
    """The log lines an episode begins with, as rows of its trace."""
    begun = replay.live.where("step = 1").select(*EPISODE)
    return begun.join(replay.logs.where("layer = 0").select("scenario_id", "log_id", "line"), "scenario_id").select(
        "episode_id", "log_id", "line")


def trace_entities(replay: Replay) -> DataFrame:
    """The entities known after each step, as rows of its trace; a submit lists none."""
    steps = replay.live.where("action_type <> 'submit'").select("episode_id", "step")
    return at_steps(spans(replay, ("discovered",)), steps).select("episode_id", "step", "value", "pii_type")
