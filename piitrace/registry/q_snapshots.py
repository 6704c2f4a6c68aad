"""Queries of observations and full traces (A8, W15)."""

from pyspark.sql import functions as F

from piitrace.plans import snapshots
from piitrace.plans.replay import step_feedback
from piitrace.registry.base import on_replay
from piitrace.registry.oracle import dbl, grade
from piitrace.registry.q_scalar import ENV_CLASS, FEEDBACK
from piitrace.sources import traces

c = F.col

#: Stretches of steps: values with their class, and lines.
_SPANS = f"""SELECT v.episode_id, v.kind, v.value, {ENV_CLASS} AS pii_type, v.from_step, v.to_step
  FROM (SELECT s.*, e.steps_used AS to_step FROM (
      SELECT episode_id, scenario_id, 'discovered' AS kind, value, discovered_at AS from_step FROM disc
      UNION ALL SELECT episode_id, scenario_id, 'redacted', value, redacted_at FROM red_at) s
      JOIN episodes e USING (episode_id)
    UNION ALL SELECT s.episode_id, s.scenario_id, 'target', s.value, s.discovered_at,
      least(coalesce(s.investigated_at - 1, e.steps_used), e.steps_used)
      FROM spans s JOIN episodes e USING (episode_id)) v
  LEFT JOIN flat f ON f.scenario_id = v.scenario_id AND f.value = v.value WHERE v.from_step <= v.to_step
  UNION ALL SELECT v.episode_id, 'visible_log', CAST(v.log_id AS VARCHAR), NULL, v.visible_at, e.steps_used
  FROM vis v JOIN episodes e USING (episode_id)"""
on_replay("w15_snapshot_spans", snapshots.spans, "SELECT * FROM stretches", stretches=_SPANS)


def _asked(r):
    """The state after reset, one step in the middle and the last one of every episode."""
    ends = r.live.groupBy("episode_id").agg(F.max("step").alias("last"))
    steps = F.array(F.lit(0), F.floor(c("last") / 2).cast("int"), c("last"))
    return snapshots.at_steps(snapshots.spans(r), ends.select("episode_id", F.explode(steps).alias("step")))


on_replay(
    "w15_snapshot_at", _asked,
    """SELECT a.episode_id, a.step, s.kind, s.value, s.pii_type
      FROM (SELECT DISTINCT episode_id, unnest([0, steps_used // 2, steps_used]) AS step FROM episodes) a
      JOIN stretches s ON s.episode_id = a.episode_id AND a.step BETWEEN s.from_step AND s.to_step""",
    stretches=_SPANS)
on_replay(
    "w15_observation_heads", snapshots.heads,
    f"""SELECT r.episode_id, r.step, visible_total, discovered_total, redacted_total AS pii_found_count,
        total_pii AS total_pii_to_find, steps_remaining, difficulty, cumulative_reward AS score_so_far, t.hint
      FROM totalled r JOIN told t ON t.episode_id = r.episode_id AND t.step = r.step
      UNION ALL SELECT l.episode_id, 0, (SELECT count(*) FROM logs g WHERE g.scenario_id = l.scenario_id
          AND g.layer = 0), 0, 0, t.total_pii, l.budget, l.difficulty, {dbl(0.05)},
        'You''re investigating a potential data breach. ' || t.total_pii || ' PII items are hidden across '
          || l.n_layers || ' layers. Start by scanning the visible logs.'
      FROM live l JOIN totals t USING (scenario_id) WHERE l.step = 1""",
    told=FEEDBACK)


def _full_trace(r):
    """Traces with feedback and final scores; the steps as text, since SQL engines differ on nested output."""
    entry = lambda s: F.concat_ws(":", s["step"].cast("string"), s["action"], s["feedback"])
    told = r.step_results.join(step_feedback(r).select("episode_id", "step", "feedback"), ["episode_id", "step"])
    return traces.build_trace(told).select(
        "episode_id", "final_score", "f1_score", "discovery_rate", "grade",
        F.concat_ws("|", F.transform("steps", entry)).alias("steps"))


on_replay(
    "a8_full_trace", _full_trace,
    f"""SELECT r.episode_id, round_even(arg_max(submit_score, r.step), 6) AS final_score,
      round_even(arg_max(f1_score, r.step), 6) AS f1_score,
      round_even(arg_max(discovery_rate, r.step), 6) AS discovery_rate,
      {grade('arg_max(submit_score, r.step)')} AS grade,
      string_agg(r.step || ':' || upper(r.action_type) || ':' || feedback, '|' ORDER BY r.step) AS steps
      FROM told t JOIN results r ON r.episode_id = t.episode_id AND r.step = t.step GROUP BY r.episode_id""",
    told=FEEDBACK)
on_replay("a8_trace_lines", snapshots.trace_lines,
          """SELECT e.episode_id, l.log_id, l.line FROM episodes e JOIN logs l USING (scenario_id)
          WHERE l.layer = 0""")
on_replay("a8_trace_entities", snapshots.trace_entities,
          f"""SELECT l.episode_id, l.step, v.value, {ENV_CLASS} AS pii_type
          FROM live l JOIN disc v ON v.episode_id = l.episode_id AND v.discovered_at <= l.step
          LEFT JOIN flat f ON f.scenario_id = l.scenario_id AND f.value = v.value
          WHERE l.action_type <> 'submit'""")
