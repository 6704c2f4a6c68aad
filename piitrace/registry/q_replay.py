"""Replay and policy queries (W)."""

from pyspark.sql import functions as F

from piitrace.functions.scores import fixed
from piitrace.plans import policy
from piitrace.plans import replay as W
from piitrace.registry.base import on_incident, on_replay
from piitrace.registry.q_graph import REACH0, STEP1

c = F.col

on_incident(
    "w1_number_steps",
    lambda i: W.number_steps(i.actions).join(
        i.scenarios.select("scenario_id", "budget"), "scenario_id").select(
        "episode_id", "step_no", "action_type",
        W.steps_remaining(c("budget"), c("step_no")).alias("remaining")),
    """SELECT episode_id, step_no, action_type, greatest(0, budget - step_no) AS remaining
      FROM numbered JOIN scenarios USING (scenario_id)""",
)
on_replay(
    "w2_live_actions",
    lambda r: r.live.select("episode_id", "step", "action_type", "target_entity", "budget",
                            "steps_remaining"),
    """SELECT episode_id, step, action_type, target_entity, budget, steps_remaining FROM live""",
)
on_replay(
    "w3_end_flags", lambda r: W.end_flags(r.live),
    """SELECT episode_id, scenario_id, max(step) AS steps_used, bool_or(terminated) AS terminated,
      bool_or(truncated) AS truncated, NOT bool_or(terminated OR truncated) AS is_running
      FROM live GROUP BY ALL""",
)
on_replay(
    "w4_effective_inv",
    lambda r: r.live.filter("inv_kind is not null").select(
        "episode_id", "step", "target_entity", "inv_kind"),
    """SELECT episode_id, step, target_entity, inv_kind FROM kinds WHERE inv_kind IS NOT NULL""",
)
on_replay("w5_visible_at", lambda r: W.visible_at(r.live, r.logs, r.edges), "SELECT * FROM vis")
on_replay("w6_discovered_at", lambda r: r.discovered_at, "SELECT * FROM disc")
on_replay("w7_redacted_at", lambda r: r.redacted_at, "SELECT * FROM red_at")
COUNTS = ["episode_id", "step", "new_logs", "new_entities", "new_secrets", "correct",
          "false_positives", "duplicates", "visible_total", "discovered_total",
          "discovered_truth", "redacted_total", "secrets_missed"]
on_replay("w8_step_counts", lambda r: r.step_counts.select(*COUNTS),
          f"SELECT {', '.join(COUNTS)} FROM running")
for _name, _action in [("w9_scan_reward", "scan"), ("w10_investigate_reward", "investigate")]:
    on_replay(
        _name,
        lambda r, a=_action: r.step_results.filter(c("action_type") == a).select(
            "episode_id", "step", f"{a}_reward"),
        f"SELECT episode_id, step, {_action}_reward FROM parts WHERE action_type = '{_action}'",
    )
on_replay(
    "w11_submit_reward",
    lambda r: r.step_results.filter("terminated or truncated").select(
        "episode_id", "step", "truncated", "reward"),
    "SELECT episode_id, step, truncated, reward FROM results WHERE terminated OR truncated",
)
on_replay(
    "w12_running_total",
    lambda r: r.step_results.select("episode_id", "step", "reward", "cumulative_reward"),
    "SELECT episode_id, step, reward, cumulative_reward FROM totalled",
)
on_replay(
    "w13_step_info", lambda r: W.step_info(r.step_results),
    """SELECT episode_id, step, cumulative_reward, redacted_total AS pii_found,
      total_pii AS pii_total FROM totalled""",
)


def _history(r):
    entry = lambda h: F.concat_ws(
        ":", h["step"].cast("string"), h["action"], F.coalesce(h["target"], F.lit("-")),
        fixed(h["reward"], 6), h["terminated"].cast("string"), h["truncated"].cast("string"))
    return W.history(r.step_results).withColumn(
        "action_history", F.concat_ws("|", F.transform("action_history", entry)))


on_replay(
    "w14_history", _history,
    """SELECT episode_id, string_agg(step || ':' || action_type || ':'
      || coalesce(target_entity, '-') || ':' || printf('%.6f', reward) || ':' || terminated || ':'
      || truncated, '|' ORDER BY step) AS action_history FROM results GROUP BY ALL""",
)
_ITEMS = """SELECT l.episode_id, l.step, 'discovered' AS kind, s.value FROM live l JOIN disc s
    ON s.episode_id = l.episode_id AND s.discovered_at <= l.step
  UNION ALL SELECT l.episode_id, l.step, 'target', s.value FROM live l JOIN spans s
    ON s.episode_id = l.episode_id AND s.discovered_at <= l.step
    AND (s.investigated_at IS NULL OR s.investigated_at > l.step)
  UNION ALL SELECT l.episode_id, l.step, 'redacted', s.value FROM live l JOIN red_at s
    ON s.episode_id = l.episode_id AND s.redacted_at <= l.step"""
on_replay("w15_snapshot_items", W.snapshot_items, _ITEMS)
on_replay(
    "w15_snapshot_logs",
    lambda r: W.snapshot_items(r, ("visible_log",)),
    """SELECT l.episode_id, l.step, 'visible_log' AS kind, CAST(v.log_id AS VARCHAR) AS value
      FROM live l JOIN vis v ON v.episode_id = l.episode_id AND v.visible_at <= l.step""",
)
on_replay(
    "w15_next_targets", W.next_targets, "SELECT * FROM nexts",
)
on_replay(
    "w16_episode_state", lambda r: W.episode_state(r.step_results),
    """SELECT episode_id, scenario_id, max(step) AS episode_step,
      arg_max(cumulative_reward, step) AS total_reward,
      arg_max(visible_total, step) AS visible_total,
      arg_max(discovered_total, step) AS discovered_total,
      arg_max(redacted_total, step) AS redacted_total, min(steps_remaining) AS steps_remaining,
      any_value(difficulty) AS difficulty, NOT bool_or(terminated OR truncated) AS is_running
      FROM totalled GROUP BY episode_id, scenario_id""",
)
on_replay(
    "w17_wasted_steps", lambda r: W.wasted_steps(r.step_results),
    """SELECT reason, count(*) AS steps FROM (SELECT CASE
        WHEN inv_kind IN ('missing', 'repeat', 'honeypot') THEN inv_kind
        WHEN inv_kind = 'effective' AND new_logs + new_entities = 0 THEN 'deadend'
        WHEN action_type = 'redact' AND correct + false_positives + duplicates = 0
          THEN 'empty_redact'
        WHEN action_type = 'scan' AND new_entities = 0 THEN 'noop_scan' END AS reason
      FROM results) WHERE reason IS NOT NULL GROUP BY ALL""",
)


#: The longest recorded plan has 12 steps.
_LAST = 12


def _driver_sql():
    """The driver's rules, one round per step."""
    out = {
        "step1": STEP1, "reach0": REACH0,
        "drafted": """SELECT a.* EXCLUDE (step, step_no), CAST(step_no AS INT) AS step, s.budget,
          CASE WHEN step_no = 1 THEN 'scan' WHEN step_no = s.budget THEN 'submit'
          ELSE action_type END AS planned
          FROM numbered a JOIN scenarios s USING (scenario_id) WHERE step_no <= s.budget""",
        "closed": """SELECT episode_id, min(CASE WHEN planned = 'submit' THEN step END) AS last
          FROM drafted GROUP BY ALL""",
        "kept": """SELECT d.* FROM drafted d JOIN closed c USING (episode_id)
          WHERE step <= coalesce(c.last, step)""",
        "known1": """SELECT DISTINCT k.episode_id, k.scenario_id, r.value FROM kept k
          JOIN reach0 r USING (scenario_id)""",
        "tried1": """SELECT episode_id, scenario_id, target_entity AS value, 0 AS step FROM kept
          WHERE false""",
    }
    for s in range(2, _LAST + 1):
        out[f"move{s}"] = f"""SELECT a.episode_id, a.scenario_id, a.target_entity AS value
          FROM kept a JOIN known{s - 1} k ON k.episode_id = a.episode_id
            AND k.value = a.target_entity
          WHERE a.step = {s} AND a.planned = 'investigate' AND NOT EXISTS (SELECT 1
            FROM tried{s - 1} t WHERE t.episode_id = a.episode_id AND t.value = a.target_entity)"""
        out[f"tried{s}"] = f"SELECT * FROM tried{s - 1} UNION ALL SELECT *, {s} FROM move{s}"
        out[f"known{s}"] = f"""SELECT * FROM known{s - 1} UNION
          SELECT m.episode_id, m.scenario_id, n.value FROM move{s} m JOIN step1 n
            ON n.scenario_id = m.scenario_id AND n.src = m.value WHERE NOT EXISTS (SELECT 1
            FROM honeypots h WHERE h.scenario_id = m.scenario_id AND h.value = m.value)"""
    return out


on_incident(
    "w18_driver_rules",
    lambda i: policy.apply_driver_rules(i.actions, i.scenarios, i.logs, i.edges, i.honeypots),
    f"""SELECT episode_id, scenario_id, strategy, step, act AS action_type,
      CASE WHEN act = 'investigate' THEN target_entity END AS target_entity,
      action_type AS planned_type FROM (SELECT k.*, CASE WHEN planned = 'investigate'
        AND NOT EXISTS (SELECT 1 FROM tried{_LAST} t WHERE t.episode_id = k.episode_id
          AND t.step = k.step) THEN 'scan' ELSE planned END AS act FROM kept k)""",
    **_driver_sql(),
)
