"""Replay of recorded episodes, all at once and without a loop over steps.

Every piece of episode state is described by the step at which it entered: a log
line becomes visible at a step, a value is discovered, investigated or redacted
at a step. Per-step results are then counts of entries per step and running sums
over at most ``budget`` rows per episode.

Cost does not follow the number of log lines times the number of episodes. Lines
of a scenario with the same label set always become visible together, so they
are folded into one class with a line count first: one pass over the logs with a
map-side combine, and everything after it works on classes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piitrace.functions.scores import (
    ENV_EPS,
    clamp,
    clamped_fold,
    coverage_text,
    fixed,
    letter_grade,
    percent,
    ratio,
)
from piitrace.operators import redaction
from piitrace.operators.graph import truth_flat
from piitrace.operators.ordering import number_within
from piitrace.operators.scoring import env_parts, score_grader
from piitrace.session import cut

# Step rewards.
SCAN_WEIGHT = 0.1
INVESTIGATE_WEIGHT = 0.15
SECRET_FOUND = 0.3
HONEYPOT_REWARD = -0.5

EPISODE = ["episode_id", "scenario_id"]


# ---------------------------------------------------------------- steps and ends


#: Actions of one recorded step follow each other in this order.
BY_STEP = ["step", "action_type", "target_entity"]


def number_steps(actions: DataFrame) -> DataFrame:
    """Step numbers 1.. per episode by recorded ``step``, whatever that looks like."""
    return number_within(actions, ["episode_id"], BY_STEP, "step_no")


def largest_budget(scenarios: DataFrame) -> int:
    """The largest budget of all scenarios: one number."""
    return scenarios.agg(F.max("budget")).first()[0] or 0


def steps_remaining(budget: Column, step: Column) -> Column:
    return F.greatest(F.lit(0), budget - step)


def live_actions(actions: DataFrame, scenarios: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Actions up to the end of each episode, numbered, with budget and end flags.

    ``step`` counts from 1 in the order of the recorded steps, which stay as
    ``recorded_step`` and may have gaps or begin anywhere. An episode ends at its first
    submit or when its budget is used up; later actions are errors and left out. No step
    past the largest budget of all scenarios can be live, so map tasks keep that many rows
    per episode before the shuffle. ``extra`` names further scenario columns to carry along.
    """
    facts = scenarios.select("scenario_id", "difficulty", "n_layers", "budget", *extra)
    by_step = Window.partitionBy("episode_id").orderBy(*BY_STEP)
    top = (
        actions.withColumn("_rn", F.row_number().over(by_step))
        .filter(F.col("_rn") <= largest_budget(scenarios))
        .withColumnRenamed("step", "recorded_step")
        .withColumn("step", F.col("_rn").cast("int"))
        .drop("_rn")
    )
    episode = Window.partitionBy("episode_id")
    at = lambda kind: F.min(F.when(F.col("action_type") == kind, F.col("step")))
    same = Window.partitionBy("episode_id", "action_type", "target_entity")
    top = top.withColumns(
        {
            "first_submit": at("submit").over(episode),
            "first_scan": at("scan").over(episode),
            "first_same": F.min("step").over(same),
        }
    )
    joined = top.join(facts, "scenario_id").withColumn("budget", F.col("budget").cast("int"))
    end = F.least("first_submit", "budget")
    live = joined.withColumn("end_step", end).filter(F.col("step") <= F.col("end_step"))
    done = F.col("action_type") == "submit"
    return live.withColumns(
        {
            "terminated": done,
            "truncated": (F.col("step") == F.col("budget")) & ~done,
            "steps_remaining": steps_remaining(F.col("budget"), F.col("step")),
            "first_scan": F.when(F.col("first_scan") <= F.col("end_step"), F.col("first_scan")),
        }
    )


def end_flags(live: DataFrame) -> DataFrame:
    """One row per episode: how it stands after its last live step."""
    return live.groupBy(*EPISODE).agg(
        F.max("step").alias("steps_used"),
        F.max("terminated").alias("terminated"),
        F.max("truncated").alias("truncated"),
    ).withColumn("is_running", ~(F.col("terminated") | F.col("truncated")))


def classify_investigations(live: DataFrame, honeypots: DataFrame) -> DataFrame:
    """Add ``inv_kind`` to investigate steps: missing, repeat, honeypot or effective.

    The target of a honeypot is recorded before the trap is sprung, so the second
    try is a repeat.
    """
    traps = honeypots.select(
        "scenario_id", F.col("value").alias("target_entity"), F.lit(True).alias("_trap")
    )
    kind = (
        F.when(F.col("action_type") != "investigate", None)
        .when(F.coalesce("target_entity", F.lit("")) == "", "missing")
        .when(F.col("step") > F.col("first_same"), "repeat")
        .when(F.col("_trap"), "honeypot")
        .otherwise("effective")
    )
    return live.join(traps, ["scenario_id", "target_entity"], "left").withColumn(
        "inv_kind", kind
    ).drop("_trap")


# ---------------------------------------------------------------- entry steps


def log_classes(logs: DataFrame) -> DataFrame:
    """Lines with the same label set per scenario, with surface and hidden line counts."""
    values = F.array_sort(F.array_distinct(F.transform("labels", lambda r: r["value"])))
    hidden = (F.col("layer") > 0).cast("bigint")
    return logs.select("scenario_id", values.alias("labels"), hidden.alias("h")).groupBy(
        "scenario_id", "labels"
    ).agg(F.sum("h").alias("n_hidden"), F.sum(1 - F.col("h")).alias("n_surface"))


def _keyed_classes(logs: DataFrame) -> DataFrame:
    """Log classes by what brings them up: (scenario_id, kind, key, labels, n).

    Surface classes are split into single values plus one row with their line
    count, so an episode meets each surface value once, not once per class.
    """
    row = lambda kind, key, labels, n: F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), labels.alias("labels"), n.alias("n")
    )
    zero, blank = F.lit(0).cast("bigint"), F.lit("")
    none = F.array().cast("array<struct<kind:string,key:string,labels:array<string>,n:bigint>>")
    surface = F.concat(
        F.array(row("scan", blank, F.array().cast("array<string>"), F.col("n_surface"))),
        F.transform("labels", lambda v: row("scan", blank, F.array(v), zero)),
    )
    hidden = F.transform(
        "labels", lambda v: row("value", v, F.col("labels"), F.col("n_hidden"))
    )
    rows = F.concat(
        F.when(F.col("n_surface") > 0, surface).otherwise(none),
        F.when(F.col("n_hidden") > 0, hidden).otherwise(none),
    )
    return (
        log_classes(logs).select("scenario_id", F.inline(rows))
        .groupBy("scenario_id", "kind", "key", "labels").agg(F.sum("n").alias("n"))
    )


def search_at(classified: DataFrame, edges: DataFrame) -> DataFrame:
    """First step at which an effective investigation searches for each value."""
    moves = classified.filter("inv_kind = 'effective'").select(
        *EPISODE, "step", F.col("target_entity").alias("src")
    )
    return (
        moves.join(edges, ["scenario_id", "src"], "left")
        .select(*EPISODE, "step", F.explode(F.array_compact(F.array("src", "dst"))).alias("value"))
        .groupBy(*EPISODE, "value").agg(F.min("step").alias("step"))
    )


def visible_at(classified: DataFrame, logs: DataFrame, edges: DataFrame) -> DataFrame:
    """Step at which each log line becomes visible in each episode; 0 for layer 0."""
    episodes = classified.select(*EPISODE).distinct()
    surface = logs.filter("layer = 0").select("scenario_id", "log_id").join(
        episodes, "scenario_id"
    ).select(*EPISODE, "log_id", F.lit(0).alias("visible_at"))
    labels = logs.filter("layer > 0").select("scenario_id", "log_id", F.inline("labels"))
    revealed = (
        labels.select("scenario_id", "log_id", "value")
        .join(search_at(classified, edges), ["scenario_id", "value"])
        .groupBy(*EPISODE, "log_id").agg(F.min("step").alias("visible_at"))
    )
    return surface.unionByName(revealed)


@dataclass(frozen=True)
class Replay:
    """Replay of recorded actions over incident tables; every table is lazy.

    ``logs`` carries its labels as an array column; ``scenarios`` has
    scenario_id, difficulty, n_layers and budget.
    """

    actions: DataFrame
    redactions: DataFrame
    logs: DataFrame
    edges: DataFrame
    honeypots: DataFrame
    truth: DataFrame
    scenarios: DataFrame

    @classmethod
    def of(cls, incident) -> Replay:
        return cls(incident.actions, incident.redactions, incident.logs, incident.edges,
                   incident.honeypots, incident.truth, incident.scenarios)

    @cached_property
    def live(self) -> DataFrame:
        """Live steps, at most ``budget`` rows per episode; written once because four
        branches of the plan start from them."""
        facts = self.scenarios.join(self.totals, "scenario_id", "left").fillna(
            0, subset=["total_pii", "total_tokens"]
        )
        steps = live_actions(self.actions, facts, extra=("total_pii", "total_tokens"))
        return cut(classify_investigations(steps, self.honeypots), "live")

    @cached_property
    def entries(self) -> DataFrame:
        """What entered when: rows (episode, scenario, value, at, n_logs).

        Rows with a value say when it was discovered. Rows without one carry line
        counts: ``at`` 0 for surface lines, else the step that revealed them.

        The log classes are read once and keyed two ways: under one key per
        scenario ("scan") the distinct surface values and the number of surface
        lines, under each value ("value") the hidden classes it occurs in. One join
        with what each episode scans and searches for gives both.
        """
        scan_key = self.live.filter("step = 1").select(
            *EPISODE, F.lit("scan").alias("kind"), F.lit("").alias("key"),
            F.col("first_scan").alias("step"),
        )
        value_keys = search_at(self.live, self.edges).select(
            *EPISODE, F.lit("value").alias("kind"), F.col("value").alias("key"), "step"
        )
        scanned = F.col("kind") == "scan"
        state = (
            scan_key.unionByName(value_keys)
            .join(_keyed_classes(self.logs), ["scenario_id", "kind", "key"])
            .groupBy(*EPISODE, "kind", "labels")
            .agg(F.min("step").alias("step"), F.max("n").alias("n"))
        )
        row = lambda v, at, n: F.struct(
            v.alias("value"), at.cast("int").alias("at"), n.cast("bigint").alias("n_logs")
        )
        lines = row(
            F.lit(None).cast("string"), F.when(scanned, 0).otherwise(F.col("step")), F.col("n")
        )
        rows = F.concat(
            F.array(lines), F.transform("labels", lambda v: row(v, F.col("step"), F.lit(0)))
        )
        rows = F.filter(rows, lambda r: r["at"].isNotNull())
        log_step = F.when(F.col("value").isNull(), F.col("at"))
        return (
            state.select(*EPISODE, F.inline(rows))
            .groupBy(*EPISODE, "value", log_step.alias("log_step"))
            .agg(F.min("at").alias("at"), F.sum("n_logs").alias("n_logs"))
            .drop("log_step")
        )

    @cached_property
    def discovered_at(self) -> DataFrame:
        return self.entries.filter("value is not null").select(
            *EPISODE, "value", F.col("at").alias("discovered_at")
        )

    @cached_property
    def investigated_at(self) -> DataFrame:
        """First step per investigated target, honeypots included."""
        return self.live.filter("inv_kind in ('effective', 'honeypot')").select(
            *EPISODE, F.col("target_entity").alias("value"), F.col("step").alias("investigated_at")
        )

    def _in_live_steps(self, items: DataFrame) -> DataFrame:
        """Items with the number of the live step that recorded them; of several redactions
        recorded under one step, the first takes the items."""
        steps = self.live.filter("action_type = 'redact'").groupBy(*EPISODE, "recorded_step").agg(
            F.min("step").alias("step"))
        return items.withColumnRenamed("step", "recorded_step").join(
            steps, ["episode_id", "recorded_step"]).drop("recorded_step")

    @cached_property
    def matched(self) -> DataFrame:
        """Items of live redact steps with their truth flags, one row per item."""
        return redaction.match_redactions(self._in_live_steps(self.redactions), self.truth)

    @cached_property
    def folded(self) -> DataFrame:
        """The same, one row per (episode, step, value) with the number of items."""
        folded = redaction.fold_items(self.redactions)
        return redaction.match_redactions(self._in_live_steps(folded), self.truth)

    @cached_property
    def redacted_at(self) -> DataFrame:
        return redaction.redacted_at(self.folded)

    @cached_property
    def totals(self) -> DataFrame:
        return truth_flat(self.truth).groupBy("scenario_id").agg(
            F.count(F.lit(1)).alias("total_pii"),
            F.count(F.when(F.col("is_token"), 1)).alias("total_tokens"),
        )

    @cached_property
    def step_counts(self) -> DataFrame:
        """Live steps with what each one added and the running totals."""
        known = truth_flat(self.truth).withColumn("_true", F.lit(True))
        # surface lines are not new at any step; they start the visible total at step 1
        found = (
            self.entries.join(known, ["scenario_id", "value"], "left")
            .groupBy("episode_id", F.greatest("at", F.lit(1)).alias("step"))
            .agg(
                F.sum(F.when(F.col("at") > 0, F.col("n_logs"))).alias("new_logs"),
                F.sum(F.when(F.col("at") == 0, F.col("n_logs"))).alias("surface_logs"),
                F.count("value").alias("new_entities"),
                F.count(F.when(F.col("is_token"), 1)).alias("new_secrets"),
                F.count(F.when(F.col("_true"), 1)).alias("new_true"),
            )
        )
        added = ["new_logs", "surface_logs", "new_entities", "new_secrets", "new_true",
                 "correct", "false_positives", "duplicates", "secrets_redacted"]
        counts = redaction.redact_counts(self.folded)
        key = ["episode_id", "step"]
        steps = (
            self.live.join(found, key, "left")
            .join(counts, key, "left")
            .fillna(0, subset=added)
        )
        so_far = Window.partitionBy("episode_id").orderBy("step").rowsBetween(
            Window.unboundedPreceding, 0
        )
        run = lambda c: F.sum(c).over(so_far)
        return steps.withColumns(
            {
                "visible_total": run(F.col("surface_logs") + F.col("new_logs")),
                "discovered_total": run("new_entities"),
                "discovered_truth": run("new_true"),
                "redacted_total": run("correct"),
                "secrets_redacted_total": run("secrets_redacted"),
            }
        ).withColumn("secrets_missed", F.col("total_tokens") - F.col("secrets_redacted_total"))

    @cached_property
    def step_results(self) -> DataFrame:
        """One row per live step: reward, running total, coverage and submit metrics."""
        n = F.col
        submit = env_parts(n("redacted_total"), n("discovered_truth"), n("total_pii"),
                           n("secrets_missed"), n("budget"), n("step"))
        steps = self.step_counts.withColumns(
            {
                "scan_reward": scan_reward(n("new_entities")),
                "investigate_reward": investigate_reward(
                    n("inv_kind"), n("new_logs"), n("new_entities"), n("new_secrets")
                ),
                "redact_reward": redaction.redact_reward(
                    n("correct"), n("false_positives"), n("duplicates"), n("secrets_redacted"),
                    n("total_pii"),
                ),
                "coverage": clamp(ratio(n("redacted_total"), n("total_pii")), ENV_EPS),
                "precision": submit["precision"],
                "recall": submit["recall"],
                "f1_score": submit["f1_score"],
                "discovery_rate": submit["discovery_rate"],
                "efficiency_bonus": submit["efficiency_bonus"],
                "secret_penalty": submit["penalty"],
                "submit_score": submit["total_score"],
            }
        )
        ends = n("terminated") | n("truncated")
        steps = steps.withColumn(
            "reward",
            F.when(ends, n("submit_score"))
            .when(n("action_type") == "scan", n("scan_reward"))
            .when(n("action_type") == "investigate", n("investigate_reward"))
            .when(n("action_type") == "redact", n("redact_reward"))
            .otherwise(F.lit(ENV_EPS)),
        )
        # at most ``budget`` rewards per episode
        so_far = Window.partitionBy("episode_id").orderBy("step").rowsBetween(
            Window.unboundedPreceding, 0
        )
        rewards = F.collect_list("reward").over(so_far)
        return steps.withColumn("cumulative_reward", clamped_fold(rewards))

    @cached_property
    def episode_scores(self) -> DataFrame:
        """The last live step of every ended episode, with its metrics and grade."""
        return self.step_results.filter("terminated or truncated").withColumn(
            "grade", letter_grade(F.col("submit_score"))
        )


    @cached_property
    def graded_counts(self) -> DataFrame:
        """What the grader counts, per ended episode: totals of the scenario less what the episode
        has, and the distinct wrong items. No list of truths is laid out per episode."""
        n = F.col
        wrong = self.folded.filter(~n("in_truth")).select("episode_id", "original").distinct()
        wrong = wrong.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_wrong"))
        last = self.step_counts.filter("terminated or truncated")
        return last.join(wrong, "episode_id", "left").select(
            "episode_id", n("step").alias("steps_used"), n("budget").alias("steps_budget"),
            n("redacted_total").alias("true_positives"),
            F.coalesce("n_wrong", F.lit(0)).cast("bigint").alias("false_positives"),
            (n("total_pii") - n("redacted_total")).alias("false_negatives"),
            n("discovered_truth").alias("discovered_count"),
            (n("total_tokens") - n("secrets_missed")).alias("secrets_found"), "secrets_missed",
            n("total_tokens").alias("secrets_total"), "total_pii",
        )

    @cached_property
    def graded(self) -> DataFrame:
        """Grader metrics and grade of every ended episode."""
        return score_grader(self.graded_counts)


# ---------------------------------------------------------------- rewards


def scan_reward(new_entities: Column) -> Column:
    return clamp(F.lit(SCAN_WEIGHT) * new_entities, ENV_EPS)


def investigate_reward(kind: Column, new_logs: Column, new_entities: Column,
                       secrets: Column) -> Column:
    """missing, repeat: margin; honeypot: penalty; nothing new: margin; else bonus."""
    bonus = clamp(F.lit(INVESTIGATE_WEIGHT) * new_entities, ENV_EPS)
    bonus = F.when(secrets > 0, clamp(bonus + F.lit(SECRET_FOUND) * secrets, ENV_EPS)).otherwise(
        bonus
    )
    return (
        F.when(kind.isin("missing", "repeat"), F.lit(ENV_EPS))
        .when(kind == "honeypot", F.lit(HONEYPOT_REWARD))
        .when((new_logs == 0) & (new_entities == 0), F.lit(ENV_EPS))
        .otherwise(bonus)
    )


def deadend_steps(step_results: DataFrame) -> DataFrame:
    """Effective investigations that brought neither a line nor a value."""
    return step_results.filter("inv_kind = 'effective' and new_logs = 0 and new_entities = 0")


def step_info(step_results: DataFrame) -> DataFrame:
    return step_results.select(
        "episode_id", "step", "cumulative_reward",
        F.col("redacted_total").alias("pii_found"), F.col("total_pii").alias("pii_total"),
    )


def history(step_results: DataFrame) -> DataFrame:
    """Action history array per episode; at most ``budget`` entries."""
    entry = F.struct("step", F.col("action_type").alias("action"),
                     F.col("target_entity").alias("target"), "reward", "terminated", "truncated")
    return step_results.groupBy("episode_id").agg(
        F.array_sort(F.collect_list(entry)).alias("action_history")
    )


def episode_state(step_results: DataFrame) -> DataFrame:
    """Latest state per episode."""
    last = F.max_by(
        F.struct("step", "cumulative_reward", "visible_total", "discovered_total",
                 "redacted_total", "steps_remaining", "difficulty", "terminated", "truncated"),
        "step",
    )
    return step_results.groupBy(*EPISODE).agg(last.alias("s")).select(
        *EPISODE, F.col("s.step").alias("episode_step"),
        F.col("s.cumulative_reward").alias("total_reward"),
        "s.visible_total", "s.discovered_total", "s.redacted_total", "s.steps_remaining",
        "s.difficulty", (~(F.col("s.terminated") | F.col("s.truncated"))).alias("is_running"),
    )


def wasted_steps(step_results: DataFrame) -> DataFrame:
    """Number of steps that earned nothing, by reason."""
    n = F.col
    items = n("correct") + n("false_positives") + n("duplicates")
    reason = (
        F.when(n("inv_kind").isin("missing", "repeat", "honeypot"), n("inv_kind"))
        .when((n("inv_kind") == "effective") & (n("new_logs") == 0) & (n("new_entities") == 0),
              "deadend")
        .when((n("action_type") == "redact") & (items == 0), "empty_redact")
        .when((n("action_type") == "scan") & (n("new_entities") == 0), "noop_scan")
    )
    return step_results.withColumn("reason", reason).filter("reason is not null").groupBy(
        "reason"
    ).agg(F.count(F.lit(1)).alias("steps"))


# ---------------------------------------------------------------- as-of views


def entity_spans(replay: Replay) -> DataFrame:
    """Per episode and discovered value: discovered_at, investigated_at, redacted_at."""
    keys = [*EPISODE, "value"]
    return replay.discovered_at.join(replay.investigated_at, keys, "left").join(
        replay.redacted_at.select(*keys, "redacted_at"), keys, "left"
    )


def next_targets(replay: Replay) -> DataFrame:
    """Smallest target after each step: over all targets, and over those not redacted.

    A value is a target from its discovery until it is investigated or the episode ends;
    the span is unrolled over these steps and reduced with a map-side minimum.
    """
    ends = end_flags(replay.live).select("episode_id", "steps_used")
    last = F.least(F.col("investigated_at") - 1, F.col("steps_used"))
    rows = entity_spans(replay).join(ends, "episode_id").withColumn("_last", last).filter("discovered_at <= _last").select(
        "episode_id", "value", "redacted_at",
        F.explode(F.sequence("discovered_at", "_last")).alias("step"),
    )
    open_ = F.col("redacted_at").isNull() | (F.col("redacted_at") > F.col("step"))
    return rows.groupBy("episode_id", "step").agg(
        F.min("value").alias("next_target"),
        F.min(F.when(open_, F.col("value"))).alias("next_suggestion"),
        F.count(F.lit(1)).alias("n_targets"),
    )


def invalid_targets(replay: Replay) -> DataFrame:
    """Investigate steps whose target is null, not discovered before the step, or
    already investigated."""
    moves = replay.live.filter("action_type = 'investigate'").select(
        *EPISODE, "step", "target_entity", "first_same"
    )
    seen = replay.discovered_at.withColumnRenamed("value", "target_entity")
    joined = moves.join(seen, [*EPISODE, "target_entity"], "left")
    reason = (
        F.when(F.coalesce("target_entity", F.lit("")) == "", "missing")
        .when(F.col("discovered_at").isNull() | (F.col("discovered_at") >= F.col("step")),
              "not_discovered")
        .when(F.col("first_same") < F.col("step"), "repeat")
    )
    return joined.withColumn("reason", reason).filter("reason is not null").select(
        "episode_id", "step", "target_entity", "reason"
    )


def snapshot_items(replay: Replay, kinds: tuple[str, ...] = ("discovered", "target", "redacted")
                   ) -> DataFrame:
    """Observation after each step as rows (episode, step, kind, value).

    Rows, not arrays: a list has no size limit, its rows stay distributed. Kind
    ``visible_log`` lists the ids of visible lines.
    """
    ends = end_flags(replay.live).select("episode_id", "steps_used")
    spans = entity_spans(replay).join(ends, "episode_id")

    def unroll(df, kind, start, stop):
        rows = df.withColumns({"_from": F.greatest(start, F.lit(1)), "_to": stop})
        return rows.filter("_from <= _to").select(
            "episode_id", F.explode(F.sequence("_from", "_to")).alias("step"),
            F.lit(kind).alias("kind"), "value",
        )

    used = F.col("steps_used")
    parts = []
    if "discovered" in kinds:
        parts.append(unroll(spans, "discovered", F.col("discovered_at"), used))
    if "target" in kinds:
        parts.append(unroll(spans, "target", F.col("discovered_at"),
                            F.least(F.col("investigated_at") - 1, used)))
    if "redacted" in kinds:
        red = replay.redacted_at.join(ends, "episode_id")
        parts.append(unroll(red, "redacted", F.col("redacted_at"), used))
    if "visible_log" in kinds:
        lines = visible_at(replay.live, replay.logs, replay.edges).join(ends, "episode_id")
        lines = lines.withColumn("value", F.col("log_id").cast("string"))
        parts.append(unroll(lines, "visible_log", F.col("visible_at"), used))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def step_feedback(replay: Replay) -> DataFrame:
    """Feedback and hint text of every step."""
    n, t = F.col, F.coalesce("target_entity", F.lit(""))
    s = lambda *parts: F.concat(*[
        F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts
    ])
    steps = replay.step_results.join(next_targets(replay), ["episode_id", "step"], "left")
    items = n("correct") + n("false_positives") + n("duplicates")
    deadend = (n("new_logs") == 0) & (n("new_entities") == 0)
    final = s(
        "📊 Final Score: ", fixed(n("submit_score"), 3), " | F1: ", fixed(n("f1_score"), 3),
        " | Discovery: ", percent(n("discovery_rate")), " | Redacted: ", n("redacted_total"), "/",
        n("total_pii"),
        F.when(n("secrets_missed") > 0,
               s(" | ⚠️ CRITICAL: ", n("secrets_missed"), " secret(s) missed!")).otherwise(""),
    )
    action, kind = n("action_type"), n("inv_kind")
    feedback = (
        F.when(n("terminated") | n("truncated"), final)
        .when(action == "scan", s("Scan complete. ", n("new_entities"),
                                  " new entities discovered."))
        .when(kind == "missing", "INVESTIGATE requires a target_entity.")
        .when(kind == "repeat", s("Already investigated '", t, "'. Try a different entity."))
        .when(kind == "honeypot", s("⚠️ Honeypot triggered: '", t,
                                    "' was a canary decoy. Penalty applied."))
        .when((kind == "effective") & deadend,
              s("Dead-end investigation: '", t, "' revealed nothing useful."))
        .when(kind == "effective", s("Investigated '", t, "'. Found ", n("new_entities"),
                                     " new entities, ", n("new_logs"), " new logs."))
        .when((action == "redact") & (items == 0), "No redactions provided.")
        .when(action == "redact", s(n("correct"), " correct, ", n("false_positives"),
                                    " false positives, ", n("duplicates"), " duplicates."))
        .otherwise("Invalid action type.")
    )
    hint = (
        F.when(n("terminated"), final)
        .when(n("truncated"), "⏰ Investigation budget exhausted. Auto-submitting findings.")
        .when((action == "scan") & (n("new_entities") > 0),
              s("Scan found ", n("new_entities"), " new entities. ",
                F.coalesce(s("Try investigating: ", n("next_target")), F.lit(""))))
        .when(action == "scan",
              "No new entities found in visible logs. Try investigating known entities.")
        .when(kind == "missing", "Please provide a target_entity to investigate.")
        .when(kind == "repeat", s("'", t, "' was already investigated. Choose another entity."))
        .when(kind == "honeypot", "Honeypot triggered. Avoid investigating obvious decoys.")
        .when((kind == "effective") & deadend,
              s("'", t, "' was a dead-end. Prioritize other entities."))
        .when(kind == "effective",
              s("Investigation of '", t, "' revealed ", n("new_logs"), " new logs and ",
                n("new_entities"), " entities.",
                F.when(n("new_secrets") > 0,
                       " 🔑 CRITICAL: Secret tokens discovered!").otherwise(""),
                F.coalesce(s(" Next target suggestion: ", n("next_suggestion")), F.lit(""))))
        .when((action == "redact") & (items == 0),
              "Please provide redactions: [{'original': '...', "
              "'type': 'email|ip|username|token'}]")
        .when(action == "redact",
              s("Redacted ", n("correct"), " items correctly.",
                F.when(n("false_positives") > 0,
                       s(" ⚠️ ", n("false_positives"), " false positives (penalty applied)."))
                .otherwise(""),
                " Coverage: ", coverage_text(n("redacted_total"), n("total_pii")),
                F.when(n("redacted_total") == n("total_pii"),
                       " 🎉 All PII found! Consider submitting.").otherwise("")))
        .otherwise("")
    )
    return steps.select("episode_id", "step", "action_type", feedback.alias("feedback"),
                        hint.alias("hint"))


def observation_summary(replay: Replay) -> DataFrame:
    """Summary of the observation after each step, one text row per fact or item."""
    counts = replay.step_results.select(
        "episode_id", "step",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("section"), text.alias("text"))
            for i, text in enumerate([
                F.concat(F.lit("Visible logs: "), F.col("visible_total").cast("string")),
                F.concat(F.lit("Steps remaining: "), F.col("steps_remaining").cast("string")),
                F.concat(F.lit("Coverage so far: "), F.col("redacted_total").cast("string"),
                         F.lit("/"), F.col("total_pii").cast("string")),
            ])
        ])),
    )
    items = snapshot_items(replay, ("discovered", "target"))
    label = F.when(F.col("kind") == "discovered", "Discovered: ").otherwise("Targets: ")
    listed = items.select(
        "episode_id", "step", F.when(F.col("kind") == "discovered", 3).otherwise(4).alias(
            "section"), F.concat(label, F.col("value")).alias("text"),
    )
    return counts.unionByName(listed)
