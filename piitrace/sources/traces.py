"""Run traces: text lines to tables and back, nested traces, model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piitrace import schemas
from piitrace.functions.scores import (
    GRADER_EPS,
    clamp,
    fixed,
    letter_grade,
    percent,
    success,
)

# The trace line formats.
START = "[START]"
STEP = "[STEP]"
END = "[END]"
TASK = "investigation"


def _field(name: str, pattern: str = r"\S*") -> Column:
    """Value of ``name=value``; null where the line lacks it or it is empty."""
    return F.nullif(
        F.regexp_extract(F.col("value"), rf"(?:^|\s){name}=({pattern})", 1), F.lit("")
    )


def _word(c: Column) -> Column:
    return F.when(c != "null", c)


def parse_starts(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").startswith(START)).select(
        "file", "line_no", _field("task").alias("task"), _field("env").alias("env"),
        _field("model").alias("model"),
    )


def parse_steps(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").startswith(STEP)).select(
        "file", "line_no", _field("step").try_cast("int").alias("step"),
        _field("action").alias("action"), _field("reward").try_cast("double").alias("reward"),
        _field("done").try_cast("boolean").alias("done"),
        _word(_field("error", ".*")).alias("error"),
    )


def parse_ends(lines: DataFrame) -> DataFrame:
    """Final lines in any of their forms; fields a form lacks are null."""
    rewards = F.transform(
        F.filter(F.split(F.coalesce(_field("rewards"), F.lit("")), ","), lambda x: x != ""),
        lambda x: x.try_cast("double"),
    )
    return lines.filter(F.col("value").startswith(END)).select(
        "file", "line_no", _field("task").alias("task"),
        _field("score").try_cast("double").alias("score"),
        _field("steps").try_cast("int").alias("steps"),
        _field("success").try_cast("boolean").alias("success"), rewards.alias("rewards"),
    )


def parse_traces(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Starts, steps and ends of ``(file, line_no, value)`` trace lines."""
    return parse_starts(lines), parse_steps(lines), parse_ends(lines)


def _yes(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def format_trace(step_results: DataFrame, env: str = "incident", model: str = "recorded"
                 ) -> DataFrame:
    """Episode results as trace lines ``(file, line_no, value)``.

    Line 0 starts an episode, each step is a line, the last line closes it. The
    closing line needs the rewards in step order: at most ``budget`` of them.
    """
    reward = clamp(F.col("reward"), GRADER_EPS)
    done = F.col("action_type") == "submit"
    steps = step_results.select(
        F.col("episode_id").cast("string").alias("file"), F.col("step").cast("bigint").alias(
            "line_no"),
        F.concat(
            F.lit(f"{STEP} step="), F.col("step").cast("string"), F.lit(" action="),
            F.col("action_type"), F.lit(" reward="), fixed(reward, 2), F.lit(" done="),
            _yes(done), F.lit(" error=null"),
        ).alias("value"),
    )
    starts = step_results.filter("step = 1").select(
        F.col("episode_id").cast("string").alias("file"), F.lit(0).cast("bigint").alias("line_no"),
        F.lit(f"{START} task={TASK} env={env} model={model}").alias("value"),
    )
    item = F.struct("step", fixed(reward, 2).alias("reward"))
    last = step_results.groupBy("episode_id").agg(
        F.max("step").alias("steps"),
        F.array_sort(F.collect_list(item)).alias("items"),
        F.max_by("submit_score", "step").alias("score"),
        F.max_by("f1_score", "step").alias("f1"),
    )
    ends = last.select(
        F.col("episode_id").cast("string").alias("file"),
        (F.col("steps") + 1).cast("bigint").alias("line_no"),
        F.concat(
            F.lit(f"{END} task={TASK} score="), fixed(clamp(F.col("score"), GRADER_EPS), 2),
            F.lit(" steps="), F.col("steps").cast("string"), F.lit(" success="),
            _yes(success(F.col("f1"))), F.lit(" rewards="),
            F.concat_ws(",", F.transform("items", lambda x: x["reward"])),
        ).alias("value"),
    )
    return starts.unionByName(steps).unionByName(ends)


def build_trace(step_results: DataFrame) -> DataFrame:
    """One nested row per episode: steps in order and the final metrics.

    A step carries counts, and its feedback if ``step_results`` has a column of that name; the lines an
    episode begins with and the values themselves are rows of ``plans.snapshots``. The final score, F1,
    discovery rate and grade stand beside the steps as well.
    """
    n = F.col
    target = (
        F.when(n("action_type") == "investigate", n("target_entity"))
        .when(n("action_type") == "redact", F.concat(
            (n("correct") + n("false_positives") + n("duplicates")).cast("string"),
            F.lit(" items")))
    )
    coverage = F.when(
        n("action_type") == "redact",
        F.concat(n("redacted_total").cast("string"), F.lit("/"), n("total_pii").cast("string")),
    )
    step = F.struct(
        "step", F.upper("action_type").alias("action"), target.alias("target"),
        n("visible_total").alias("logs_visible"), n("discovered_total").alias("entities_found"),
        F.bround("reward", 3).alias("reward"), coverage.alias("coverage"), "steps_remaining",
        *(["feedback"] if "feedback" in step_results.columns else []),
    )
    final = F.max_by(
        F.struct(
            *[F.bround(c, 6).alias(c) for c in
              ("precision", "recall", "f1_score", "discovery_rate", "efficiency_bonus")],
            F.bround("submit_score", 6).alias("total_score"),
            letter_grade(n("submit_score")).alias("grade"),
        ),
        "step",
    )
    return step_results.groupBy("episode_id", "difficulty", "budget", "total_pii").agg(
        F.array_sort(F.collect_list(step)).alias("steps"), final.alias("final_metrics")
    ).withColumn(
        "total_reward",
        F.bround(F.aggregate("steps", F.lit(0.0), lambda a, s: a + s["reward"]), 6),
    ).withColumns({
        "final_score": n("final_metrics.total_score"), "f1_score": n("final_metrics.f1_score"),
        "discovery_rate": n("final_metrics.discovery_rate"), "grade": n("final_metrics.grade"),
    })


def write_traces(traces: DataFrame, path: str) -> None:
    traces.write.json(path)


def parse_agent_json(df: DataFrame, col: str = "answer") -> DataFrame:
    """Action out of a raw model answer, or an ``error`` code.

    Takes the text from the first ``{`` to the last ``}``, parses it, lower-cases
    the action and tests it. Codes: ``no_json``, ``bad_json``, ``bad_action``,
    ``no_target``.
    """
    text = F.regexp_extract(F.col(col), r"(?s)\{.*\}", 0)
    data = F.from_json(text, schemas.AGENT_JSON, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(text)
    action = F.lower(data["action"])
    target = F.nullif(data["target"], F.lit(""))
    error = (
        F.when(F.coalesce(text, F.lit("")) == "", "no_json")
        .when(keys.isNull(), "bad_json")
        .when(~F.coalesce(action.isin(*schemas.ACTION_TYPES), F.lit(False)), "bad_action")
        .when((action == "investigate") & target.isNull(), "no_target")
    )
    out = df.withColumns({"_error": error, "_action": action, "_target": data["target"],
                          "_reason": F.coalesce(data["reason"], F.lit(""))})
    ok = F.col("_error").isNull()
    return out.select(
        *df.columns,
        F.when(ok, F.col("_action")).alias("action"),
        F.when(ok, F.col("_target")).alias("target"),
        F.when(ok, F.col("_reason")).alias("reason"),
        F.col("_error").alias("error"),
    )


def run_lines(results: DataFrame) -> DataFrame:
    """One text line per run, most useful columns side by side."""
    return results.withColumn(
        "status", F.when(F.col("success"), "PASS").otherwise("FAIL")
    ).withColumn("discovery_text", percent(F.col("discovery_rate")))
