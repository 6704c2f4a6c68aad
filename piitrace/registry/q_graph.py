"""Entity graph, reveal and discovery queries (D)."""

from pyspark.sql import functions as F

from piitrace.operators import graph as G
from piitrace.plans import policy
from piitrace.plans import replay as W
from piitrace.registry.base import on_incident, on_replay

c = F.col

on_incident("d1_user_edges", lambda i: G.user_edges(i.users), "SELECT * FROM user_edges")
on_incident("d2_secret_edges", lambda i: G.secret_edges(i.users, i.secrets),
            "SELECT * FROM secret_edges")


def _vertices(i):
    asked = i.actions.filter("target_entity is not null").select(
        "scenario_id", c("target_entity").alias("value"))
    return asked.unionByName(i.truth.select("scenario_id", "value"))


on_incident(
    "d3_deadends", lambda i: G.deadends(_vertices(i), i.edges),
    """SELECT scenario_id, value FROM (SELECT scenario_id, target_entity AS value FROM actions
      WHERE target_entity IS NOT NULL UNION SELECT scenario_id, value FROM truth)
      EXCEPT SELECT scenario_id, src FROM edges""",
)
on_incident("d4_honeypots", lambda i: G.honeypots(i.honeypots),
            "SELECT DISTINCT scenario_id, value FROM honeypots")


def _targets(i):
    return i.actions.filter("target_entity is not null").select(
        "scenario_id", c("target_entity").alias("target")).distinct()


_TARGETS = """SELECT DISTINCT scenario_id, target_entity AS target FROM actions
  WHERE target_entity IS NOT NULL"""
_SEARCHED = """SELECT scenario_id, target, target AS value FROM asked UNION
  SELECT a.scenario_id, a.target, e.dst FROM asked a JOIN edges e
  ON e.scenario_id = a.scenario_id AND e.src = a.target"""
on_incident(
    "d5_neighbours", lambda i: G.neighbours(_targets(i), i.edges),
    """SELECT a.scenario_id, a.target, e.dst FROM asked a JOIN edges e
      ON e.scenario_id = a.scenario_id AND e.src = a.target""", asked=_TARGETS,
)
on_incident("d6_search_set", lambda i: G.search_set(_targets(i), i.edges),
            "SELECT * FROM searched", asked=_TARGETS, searched=_SEARCHED)


def _revealed(i):
    return G.reveal(i.logs, i.log_pii, G.search_set(_targets(i), i.edges))


_REVEALED = """SELECT l.scenario_id, l.log_id FROM logs l WHERE l.layer > 0 AND EXISTS (
  SELECT 1 FROM log_pii p JOIN searched s ON s.scenario_id = p.scenario_id
  AND s.value = p.value WHERE p.log_id = l.log_id)"""
on_incident("d7_reveal", lambda i: _revealed(i).select("scenario_id", "log_id"),
            "SELECT * FROM revealed", asked=_TARGETS, searched=_SEARCHED, revealed=_REVEALED)
on_incident(
    "d8_discover",
    lambda i: G.discover(_revealed(i), i.log_pii,
                         G.discover(G.initial_visible(i.logs), i.log_pii)),
    """SELECT DISTINCT p.scenario_id, p.value FROM log_pii p JOIN revealed r
        ON r.log_id = p.log_id
      EXCEPT SELECT p.scenario_id, p.value FROM log_pii p JOIN logs l ON l.log_id = p.log_id
        WHERE l.layer = 0""", asked=_TARGETS, searched=_SEARCHED, revealed=_REVEALED,
)
KEYS = ["episode_id", "scenario_id", "value"]
on_replay(
    "d9_targets", lambda r: G.targets(r.discovered_at, r.investigated_at, KEYS),
    """SELECT episode_id, scenario_id, value FROM disc EXCEPT
      SELECT episode_id, scenario_id, value FROM inv_at""",
)
on_replay(
    "d10_suggestions",
    lambda r: G.suggestions(r.discovered_at, r.investigated_at, r.redacted_at, KEYS).groupBy(
        "episode_id").agg(F.min("value").alias("suggestion"), F.count(F.lit(1)).alias("n")),
    """SELECT episode_id, min(value) AS suggestion, count(*) AS n FROM (
      SELECT episode_id, value FROM disc EXCEPT SELECT episode_id, value FROM inv_at
      EXCEPT SELECT episode_id, value FROM red_at) GROUP BY ALL""",
)
on_incident(
    "d11_honeypot_hits",
    lambda i: G.honeypot_hits(i.actions, i.honeypots).select(
        "episode_id", "step", "target_entity"),
    """SELECT episode_id, step, target_entity FROM actions a WHERE action_type = 'investigate'
      AND EXISTS (SELECT 1 FROM honeypots h WHERE h.scenario_id = a.scenario_id
        AND h.value = a.target_entity)""",
)
on_replay(
    "d12_new_secrets",
    lambda r: G.new_secrets(r.discovered_at, r.truth).select("episode_id", "value",
                                                             "discovered_at"),
    """SELECT d.episode_id, d.value, d.discovered_at FROM disc d JOIN flat f
      ON f.scenario_id = d.scenario_id AND f.value = d.value WHERE f.is_token = 1""",
)
on_replay(
    "d13_deadend_steps",
    lambda r: W.deadend_steps(r.step_results).select("episode_id", "step", "target_entity"),
    """SELECT episode_id, step, target_entity FROM results WHERE inv_kind = 'effective'
      AND new_logs = 0 AND new_entities = 0""",
)
on_incident("d14_truth", lambda i: G.truth_table(i.users, i.secrets, i.phones),
            "SELECT * FROM truth")
on_incident(
    "d14_truth_flat", lambda i: G.truth_flat(i.truth).withColumn(
        "is_token", c("is_token").cast("int")), "SELECT * FROM flat")
on_replay(
    "d15_remaining",
    lambda r: G.remaining(r.truth, r.matched.select(
        "episode_id", "scenario_id", c("original").alias("value"))),
    """SELECT DISTINCT m.episode_id, f.scenario_id, f.value FROM flat f JOIN matched m
      ON m.scenario_id = f.scenario_id EXCEPT
      SELECT episode_id, scenario_id, original FROM matched""",
)
on_incident(
    "d16_entity_layer", lambda i: G.entity_layer(i.truth, i.logs, i.log_pii, i.scenarios),
    """SELECT f.scenario_id, f.value, coalesce((SELECT min(l.layer) FROM log_pii p JOIN logs l
      ON l.log_id = p.log_id WHERE p.scenario_id = f.scenario_id AND p.value = f.value),
      s.n_layers - 1) AS layer FROM flat f JOIN scenarios s USING (scenario_id)""",
)
on_incident(
    "d17_pii_by_layer", lambda i: G.pii_by_layer(i.logs),
    """SELECT DISTINCT p.scenario_id, l.layer, p.value FROM log_pii p JOIN logs l
      ON l.log_id = p.log_id""",
)
on_incident(
    "d18_undiscoverable", lambda i: G.undiscoverable(i.truth, i.log_pii),
    """SELECT * FROM truth t WHERE NOT EXISTS (SELECT 1 FROM log_pii p
      WHERE p.scenario_id = t.scenario_id AND p.value = t.value)""",
)
# what investigating ``src`` brings up, and the surface values
STEP1 = """SELECT DISTINCT h.scenario_id, h.src, p.value FROM (
    SELECT scenario_id, value AS src, value AS hit FROM log_pii
    UNION SELECT scenario_id, src, dst FROM edges) h
  JOIN log_pii q ON q.scenario_id = h.scenario_id AND q.value = h.hit
  JOIN logs l ON l.log_id = q.log_id AND l.layer > 0
  JOIN log_pii p ON p.log_id = l.log_id"""
REACH0 = """SELECT DISTINCT p.scenario_id, p.value, 0 AS k FROM log_pii p JOIN logs l
  ON l.log_id = p.log_id WHERE l.layer = 0"""


def _rounds(n):
    """One expression per round: what was known, and what it leads to."""
    out = {"step1": STEP1, "reach0": REACH0}
    for k in range(1, n + 1):
        out[f"reach{k}"] = f"""SELECT scenario_id, value, min(k) AS k FROM (
          SELECT * FROM reach{k - 1} UNION ALL SELECT s.scenario_id, s.value, {k}
          FROM reach{k - 1} r JOIN step1 s ON s.scenario_id = r.scenario_id AND s.src = r.value)
          GROUP BY ALL"""
    return out


on_incident(
    "d19_reachable", lambda i: policy.reachable(i.logs, i.edges),
    # With up to ten users a scenario no chain is longer; a further round would find nothing.
    "SELECT scenario_id, value, k AS reached FROM reach12", **_rounds(12),
)
on_replay(
    "d20_invalid_targets", W.invalid_targets,
    """SELECT * FROM (SELECT l.episode_id, l.step, l.target_entity,
      CASE WHEN coalesce(l.target_entity, '') = '' THEN 'missing'
        WHEN NOT EXISTS (SELECT 1 FROM disc d WHERE d.episode_id = l.episode_id
          AND d.value = l.target_entity AND d.discovered_at < l.step) THEN 'not_discovered'
        WHEN l.inv_kind = 'repeat' THEN 'repeat' END AS reason
      FROM kinds l WHERE l.action_type = 'investigate') WHERE reason IS NOT NULL""",
)
