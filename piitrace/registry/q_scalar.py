"""Source and scalar queries (A, B)."""

from pyspark.sql import functions as F

from piitrace.functions import entities as N
from piitrace.functions import scores as S
from piitrace.operators import extract as X
from piitrace.operators import graph
from piitrace.plans import replay as W
from piitrace.registry.base import add, incident, on_incident, on_replay, table
from piitrace.registry.oracle import c01, c05, clamp, dbl, grade
from piitrace.session import scratch
from piitrace.sources import dims, readers, traces

c = F.col

# ---- A: sources and sinks



def _nested(i):
    """The logs of each scenario as one row with an array per layer."""
    entry = F.struct("log_id", "line")
    layers = i.logs.groupBy("scenario_id", "layer").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"))
    full = i.scenarios.select("scenario_id", F.explode(F.sequence(
        F.lit(0), c("n_layers") - 1)).alias("layer")).join(layers, ["scenario_id", "layer"], "left")
    empty = F.array().cast("array<struct<log_id:bigint,line:string>>")
    rows = F.struct("layer", F.coalesce("entries", empty).alias("entries"))
    return full.groupBy("scenario_id").agg(F.transform(
        F.array_sort(F.collect_list(rows)), lambda r: r["entries"]).alias("layers"))


on_incident(
    "a1_flatten_layers",
    lambda i: graph.flatten_layers(_nested(i).withColumn("layers", F.transform(
        "layers", lambda e: F.transform(e, lambda r: F.struct(r["line"].alias("line")))))),
    """SELECT scenario_id, row_number() OVER (PARTITION BY scenario_id ORDER BY layer, log_id) - 1
      AS log_id, layer, line FROM logs""",
)
on_incident(
    "a1_index_logs",
    lambda i: graph.index_logs(i.logs).select("scenario_id", "log_id", "layer", "log_index"),
    """SELECT scenario_id, log_id, layer, row_number() OVER (PARTITION BY scenario_id
      ORDER BY layer, log_id) - 1 AS log_index FROM logs""",
)
on_incident(
    "a2_initial_visible",
    lambda i: graph.initial_visible(i.logs).select("scenario_id", "log_id", "line"),
    "SELECT scenario_id, log_id, line FROM logs WHERE layer = 0",
)


def _read_back(fmt):
    def build(spark, folder):
        path = scratch(spark, f"logs-{fmt}")
        logs = incident(spark, folder).logs.select("scenario_id", "log_id", "layer", "line")
        if fmt == "text":
            logs.select("line").write.text(path)
            return readers.read_logs(spark, path, fmt).groupBy("line").agg(
                F.count(F.lit(1)).alias("n"))
        logs.write.format(fmt).save(path)
        return readers.read_logs(spark, path, fmt)

    return build


for _fmt in ("json", "parquet"):
    add(f"a3_read_logs_{_fmt}", _read_back(_fmt), "SELECT * FROM logs")
add("a3_read_logs_text", _read_back("text"),
    "SELECT line, count(*) AS n FROM logs GROUP BY ALL")

def _record():
    """Raw action records: recorded actions, some of them damaged by a fixed rule."""
    bad = (c("episode_id") * 7 + c("step")) % 10
    return F.concat(
        F.lit('{"episode_id":'), c("episode_id").cast("string"), F.lit(',"scenario_id":'),
        c("scenario_id").cast("string"), F.lit(',"strategy":'), c("strategy").cast("string"),
        F.when(bad == 3, F.lit("")).otherwise(
            F.concat(F.lit(',"step":'), c("step").cast("string"))),
        F.lit(',"action_type":"'), F.when(bad == 4, F.lit("delete")).otherwise(c("action_type")),
        F.lit('","target_entity":"'), F.coalesce("target_entity", F.lit("")),
        F.when(bad == 5, F.lit('"')).otherwise(F.lit('"}')),
    )


def _records(spark, folder):
    path = scratch(spark, "actions")
    incident(spark, folder).actions.select(_record().alias("value")).write.text(path)
    return readers.read_actions(spark, path)


_BAD_SQL = "(episode_id * 7 + step) % 10"
add(
    "a4_read_actions",
    lambda spark, folder: _records(spark, folder)[0],
    f"""SELECT episode_id, scenario_id, strategy, step, action_type,
      coalesce(target_entity, '') AS target_entity FROM actions
      WHERE {_BAD_SQL} NOT IN (3, 4, 5)""",
)
add(
    "a4_action_rejects",
    lambda spark, folder: _records(spark, folder)[2].groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("n")),
    f"""SELECT CASE {_BAD_SQL} WHEN 3 THEN 'episode' WHEN 4 THEN 'action_type' ELSE 'malformed'
      END AS reject_reason, count(*) AS n FROM actions WHERE {_BAD_SQL} IN (3, 4, 5)
      GROUP BY ALL""",
)
on_incident(
    "a5_difficulty_cfg",
    lambda i: i.scenarios.select("scenario_id", "difficulty").join(
        F.broadcast(dims.difficulty_cfg(i.spark)), "difficulty"
    ).groupBy("difficulty", "n_users", "n_layers", "budget", "n_secrets", "n_decoys",
              "n_deadends").agg(F.count(F.lit(1)).alias("scenarios")),
    """SELECT c.*, count(*) AS scenarios FROM cfg c JOIN scenarios s USING (difficulty)
      GROUP BY ALL""",
)
on_incident(
    "a6_decoys",
    lambda i: X.all_matches(i.logs, "line", ("log_id",), "server").join(
        F.broadcast(dims.decoys(i.spark)), ["pii_type", "value"]
    ).groupBy("pii_type", "value").agg(F.count(F.lit(1)).alias("n")),
    """SELECT pii_type, value, count(*) AS n FROM server_hits JOIN decoys USING (pii_type, value)
      GROUP BY ALL""",
)
on_incident(
    "a11_scenario_info",
    lambda i: graph.scenario_info(i.scenarios, i.truth),
    """SELECT s.scenario_id AS scenario_seed, s.difficulty, t.total_pii, s.n_layers, s.budget
      FROM scenarios s JOIN totals t USING (scenario_id)""",
)

# ---- A7-A10: traces

_LINES = """
  SELECT CAST(episode_id AS VARCHAR) AS file, 0 AS line_no,
    '[START] task=investigation env=incident model=recorded' AS value FROM results WHERE step = 1
  UNION ALL SELECT CAST(episode_id AS VARCHAR), step, '[STEP] step=' || step || ' action='
    || action_type || ' reward=' || printf('%.2f', {held}) || ' done='
    || CASE WHEN action_type = 'submit' THEN 'true' ELSE 'false' END || ' error=null' FROM results
  UNION ALL SELECT CAST(episode_id AS VARCHAR), max(step) + 1,
    '[END] task=investigation score=' || printf('%.2f', {score}) || ' steps=' || max(step)
    || ' success=' || CASE WHEN arg_max(f1_score, step) >= 0.7 THEN 'true' ELSE 'false' END
    || ' rewards=' || string_agg(printf('%.2f', {held}), ',' ORDER BY step)
    FROM results GROUP BY episode_id
""".format(held=c01("reward"), score=c01("arg_max(submit_score, step)"))


def _trace(part):
    return lambda r: traces.parse_traces(traces.format_trace(r.step_results))[part]


on_replay("a7_parse_starts", _trace(0),
          """SELECT file, line_no, 'investigation' AS task, 'incident' AS env,
          'recorded' AS model FROM trace WHERE value LIKE '[START]%'""", trace=_LINES)
on_replay(
    "a7_parse_steps", _trace(1),
    r"""SELECT file, line_no, CAST(regexp_extract(value, ' step=(\d+)', 1) AS INT) AS step,
      regexp_extract(value, 'action=(\w+)', 1) AS action,
      CAST(regexp_extract(value, 'reward=(\S+)', 1) AS DOUBLE) AS reward,
      regexp_extract(value, 'done=(\w+)', 1) = 'true' AS done,
      nullif(regexp_extract(value, 'error=(.*)', 1), 'null') AS error
      FROM trace WHERE value LIKE '[STEP]%'""", trace=_LINES)
on_replay(
    "a7_parse_ends",
    lambda r: _trace(2)(r).withColumn(
        "rewards", F.concat_ws(",", F.transform("rewards", lambda x: S.fixed(x, 2)))),
    r"""SELECT file, line_no, 'investigation' AS task,
      CAST(regexp_extract(value, 'score=(\S+)', 1) AS DOUBLE) AS score,
      CAST(regexp_extract(value, 'steps=(\d+)', 1) AS INT) AS steps,
      regexp_extract(value, 'success=(\w+)', 1) = 'true' AS success,
      regexp_extract(value, 'rewards=(\S*)', 1) AS rewards
      FROM trace WHERE value LIKE '[END]%'""", trace=_LINES)


def _trace_text(r):
    """Nested traces with each step as text, since SQL engines differ on nested output."""
    entry = lambda s: F.concat_ws(
        ":", s["step"].cast("string"), s["action"], F.coalesce(s["target"], F.lit("-")),
        s["logs_visible"].cast("string"), s["entities_found"].cast("string"),
        S.fixed(s["reward"], 3), F.coalesce(s["coverage"], F.lit("-")),
        s["steps_remaining"].cast("string"))
    return traces.build_trace(r.step_results).select(
        "episode_id", "difficulty", "budget", "total_pii", "total_reward",
        F.concat_ws("|", F.transform("steps", entry)).alias("steps"),
        "final_metrics.total_score", "final_metrics.grade")


on_replay(
    "a8_build_trace", _trace_text,
    f"""SELECT episode_id, difficulty, budget, total_pii,
      round(list_sum(list(round_even(reward, 3) ORDER BY step)), 6) AS total_reward,
      string_agg(step || ':' || upper(action_type) || ':' || CASE
          WHEN action_type = 'investigate' THEN coalesce(target_entity, '-')
          WHEN action_type = 'redact' THEN (correct + false_positives + duplicates) || ' items'
          ELSE '-' END || ':' || visible_total || ':' || discovered_total || ':'
        || printf('%.3f', reward) || ':' || CASE WHEN action_type = 'redact'
          THEN redacted_total || '/' || total_pii ELSE '-' END || ':' || steps_remaining,
        '|' ORDER BY step) AS steps,
      round_even(arg_max(submit_score, step), 6) AS total_score,
      {grade('arg_max(submit_score, step)')} AS grade
      FROM results GROUP BY episode_id, difficulty, budget, total_pii""",
)
on_replay("a9_format_trace", lambda r: traces.format_trace(r.step_results),
          "SELECT * FROM trace", trace=_LINES)


def _scores_back(spark, folder):
    from piitrace.registry.base import replay

    path = scratch(spark, "scores")
    scores = replay(spark, folder).episode_scores.select(
        "episode_id", "difficulty", "step", "submit_score", "f1_score", "grade")
    readers.write_scores(scores, path)
    return spark.read.schema(scores.schema).parquet(path)


add("a10_write_scores", _scores_back,
    "SELECT episode_id, difficulty, step, submit_score, f1_score, grade FROM finals")

# ---- B: scalars

def _shifted():
    return F.nullif(c("value") / 50 - 0.2, F.lit(0.0))


_X_SQL = "nullif(value / 50 - CAST(0.2 AS DOUBLE), 0)"
for _name, _eps in [("b1_clamp", 0.05), ("b2_grader_clamp", 0.01), ("b3_report_clamp", 0.01)]:
    _scale = {"b1_clamp": 1, "b2_grader_clamp": 2, "b3_report_clamp": 3}[_name]
    add(
        _name,
        lambda spark, folder, e=_eps, k=_scale: table(spark, folder, "events").select(
            "event_id", S.clamp(_shifted() / k, e).alias("score")),
        f"SELECT event_id, {clamp(f'{_X_SQL} / {_scale}', _eps)} AS score FROM events",
    )


def _rewards(r):
    n = c
    rows = r.step_results.select(
        "episode_id", "step",
        F.when(n("action_type") == "redact", n("redact_reward")).alias("redaction_score"),
        F.when(n("action_type") == "scan", n("scan_reward")).alias("discovery_bonus"),
        (n("efficiency_bonus") * 4).alias("efficiency_bonus"),
        F.when(n("terminated"), n("secret_penalty")).otherwise(0.0).alias("penalty"),
        n("reward").alias("total_reward"),
        F.create_map(
            F.lit("precision"), n("precision") * 1.2, F.lit("coverage"), n("coverage") - 0.2,
            F.lit("correct"), n("correct").cast("double"),
        ).alias("metrics"),
    )
    out = S.reward_components(rows)
    return out.select(
        "episode_id", "step", "redaction_score", "discovery_bonus", "efficiency_bonus", "penalty",
        "total_reward", "score",
        *[c("metrics")[k].alias(f"m_{k}") for k in ("precision", "coverage", "correct")],
    )


on_replay(
    "b4_normalise_reward", _rewards,
    f"""SELECT episode_id, step,
      {c05("CASE WHEN action_type = 'redact' THEN redact_reward END")} AS redaction_score,
      {c05("CASE WHEN action_type = 'scan' THEN scan_reward END")} AS discovery_bonus,
      {c05('efficiency_bonus * 4')} AS efficiency_bonus,
      CASE WHEN terminated THEN secret_penalty ELSE 0 END AS penalty,
      reward AS total_reward, {c05('reward')} AS score,
      {c05('precision * CAST(1.2 AS DOUBLE)')} AS m_precision,
      {c05('coverage - CAST(0.2 AS DOUBLE)')} AS m_coverage,
      CAST(correct AS DOUBLE) AS m_correct FROM results""",
)
add(
    "b5_letter_grade",
    lambda spark, folder: table(spark, folder, "events").select(
        "event_id", S.letter_grade(c("value") / 50).alias("grade")),
    f"SELECT event_id, {grade('value / 50')} AS grade FROM events",
)


def _values(spark, folder):
    """Distinct values of every origin: labels, matches, redaction lists, truth."""
    i = incident(spark, folder)
    v = lambda df, col="value": df.select(c(col).alias("value"))
    return (
        v(i.log_pii).unionByName(v(X.all_matches(i.logs))).unionByName(v(i.redactions, "original"))
        .unionByName(v(i.truth))
        .unionByName(v(X.all_matches(table(spark, folder, "documents"), "text", ("doc_id",))))
        .distinct()
    )


_QUAD = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
_IPV4 = r"""(len(string_split(value, '.')) = 4 AND list_bool_and(list_transform(
  string_split(value, '.'), lambda p: coalesce(regexp_matches(p, '^[0-9]+$')
    AND try_cast(p AS HUGEINT) <= 255, false))))"""
_PHONES = [r"^\+1-[0-9]{3}-[0-9]{3}-[0-9]{4}$", r"^\+91-[0-9]{5}-[0-9]{5}$",
           r"^\+44-20-[0-9]{4}-[0-9]{4}$", r"^\+1-555-[0-9]{4}-[0-9]{3}$"]


def _phone_sql(n):
    return "(" + " OR ".join(f"regexp_matches(trim(value), '{p}')" for p in _PHONES[:n]) + ")"


_GENERIC = r"regexp_matches(value, '^\+[0-9]{1,3}-[0-9]{3}-[0-9]{3}-[0-9]{4}$')"
_AT = "contains(value, '@') AND contains(value, '.')"

#: The class of ``v.value``, with ``f`` the truth values of its scenario.
ENV_CLASS = f"""CASE WHEN {_AT.replace('value', 'v.value')} THEN 'email'
      WHEN regexp_matches(v.value, '{_QUAD}') THEN 'ip'
      WHEN f.is_token = 1 THEN 'token' ELSE 'username' END"""

on_incident(
    "b6_classify_env",
    lambda i: N.classify_env(
        i.log_pii.select("scenario_id", "value").unionByName(
            i.redactions.select((F.floor(c("episode_id") / 5)).alias("scenario_id"),
                                c("original").alias("value"))).distinct(), i.truth),
    f"""SELECT v.scenario_id, v.value, {ENV_CLASS} AS entity_class
      FROM (SELECT scenario_id, value FROM log_pii UNION
        SELECT episode_id // 5, original FROM redactions) v
      LEFT JOIN flat f USING (scenario_id, value)""",
)
_HEADS = ["sk_live_", "sk_test_", "ghp_", "hf_", "akia", "asia", "api_key_", "xoxp-", "xoxb-",
          "bearer "]
_HEAD_SQL = " OR ".join(f"starts_with(lower(value), '{h}')" for h in _HEADS)
for _mode, _n in [("strict", 3), ("fixed", 4)]:
    add(
        f"b7_classify_driver_{_mode}",
        lambda spark, folder, m=_mode: _values(spark, folder).withColumn(
            "entity_class", N.classify_driver(c("value"), m)),
        f"""SELECT value, CASE WHEN {_AT} THEN 'email' WHEN {_phone_sql(_n)} THEN 'phone'
          WHEN {_IPV4} THEN 'ip' WHEN {_HEAD_SQL} OR length(value) > 24 THEN 'token'
          ELSE 'username' END AS entity_class FROM entity_values""",
    )
add(
    "b8_classify_server",
    lambda spark, folder: _values(spark, folder).withColumn(
        "entity_class", N.classify_server(c("value"))),
    rf"""SELECT value, CASE WHEN contains(value, '@') THEN 'email'
      WHEN regexp_matches(value, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') THEN 'ip'
      WHEN {_GENERIC} THEN 'phone' WHEN length(value) > 15 THEN 'token' ELSE 'username' END
      AS entity_class FROM entity_values""",
)
add(
    "b9_classify_test",
    lambda spark, folder: _values(spark, folder).withColumn(
        "entity_class", N.classify_test(c("value"))),
    f"""SELECT value, CASE WHEN contains(value, '@') THEN 'email' WHEN {_GENERIC} THEN 'phone'
      WHEN regexp_matches(value, '{_QUAD}') THEN 'ip' WHEN length(value) > 15 THEN 'token'
      ELSE 'username' END AS entity_class FROM entity_values""",
)
add(
    "b10_is_ipv4",
    lambda spark, folder: _values(spark, folder).withColumn("ok", N.is_ipv4(c("value"))),
    f"SELECT value, {_IPV4} AS ok FROM entity_values",
)
for _mode, _n in [("strict", 3), ("fixed", 4)]:
    add(
        f"b11_is_phone_{_mode}",
        lambda spark, folder, m=_mode: _values(spark, folder).withColumn(
            "ok", N.is_phone(c("value"), m)),
        f"SELECT value, {_phone_sql(_n)} AS ok FROM entity_values",
    )
_HEADER = N.HEADER.replace("'", "''")
on_incident(
    "b12_parse_line",
    lambda i: N.parse_line(i.logs).select(
        "log_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "category", "service",
        "message"),
    f"""SELECT log_id, strftime(try_cast(nullif(regexp_extract(line, '{_HEADER}', 1), '') AS TIMESTAMP),
        '%Y-%m-%d %H:%M:%S') AS ts, nullif(regexp_extract(line, '{_HEADER}', 2), '') AS category,
      nullif(regexp_extract(line, '{_HEADER}', 3), '') AS service,
      nullif(regexp_extract(line, '{_HEADER}', 4), '') AS message FROM logs""",
)
on_incident(
    "b13_time_part",
    lambda i: i.logs.select("log_id", N.time_part(c("line")).alias("time_part")),
    "SELECT log_id, string_split(line, ' ')[2] AS time_part FROM logs",
)
on_incident(
    "b14_base64_encode",
    lambda i: i.logs.select("log_id", N.b64(c("line")).alias("encoded")),
    "SELECT log_id, base64(encode(line)) AS encoded FROM logs",
)


def _decoded(i):
    return X.extract(i.logs, "E10").select(
        "log_id", "match_ord", N.b64_decode(c("value")).alias("strict"),
        N.b64_decode(c("value"), strict=False).alias("repaired"))


on_incident(
    "b15_base64_decode", _decoded,
    """SELECT log_id, 0 AS match_ord,
      CASE WHEN length(v) % 4 = 0 THEN decode(from_base64(v)) END AS strict,
      decode(from_base64(rpad(v, CAST(ceil(length(v) / 4) * 4 AS INT), '='))) AS repaired
      FROM (SELECT log_id, rtrim(regexp_extract(line, 'b64=([A-Za-z0-9+/]+)', 1), '=') AS v
        FROM logs) WHERE length(v) >= 16""",
)
on_incident(
    "b16_mask_secret",
    lambda i: i.secrets.select("scenario_id", "token", N.mask_secret(c("token")).alias("masked")),
    "SELECT scenario_id, token, 'sk_l**e_' || right(token, 8) AS masked FROM secrets",
)
on_incident(
    "b17_title",
    lambda i: i.users.select("user_id", N.title(c("username")).alias("title")),
    "SELECT user_id, upper(username[1]) || username[2:] AS title FROM people",
)
on_replay(
    "b18_coverage_text",
    lambda r: r.step_results.select(
        "episode_id", "step", S.coverage_text(c("redacted_total"), c("total_pii")).alias("text")),
    """SELECT episode_id, step, redacted_total || '/' || total_pii || ' (' ||
      printf('%.0f', CAST(redacted_total AS DOUBLE) / total_pii * 100) || '%)' AS text
      FROM results""",
)
on_replay(
    "b19_round_trace",
    lambda r: S.rounded_trace(
        r.step_results.select("episode_id", "step", "reward", "submit_score", "f1_score"),
        "reward", ("submit_score", "f1_score")),
    """SELECT episode_id, step, round_even(reward, 3) AS reward,
      round_even(submit_score, 6) AS submit_score, round_even(f1_score, 6) AS f1_score
      FROM results""",
)
FEEDBACK = """SELECT r.episode_id, r.step, action_type,
      CASE WHEN terminated OR truncated THEN final
        WHEN action_type = 'scan' THEN 'Scan complete. ' || new_entities
          || ' new entities discovered.'
        WHEN inv_kind = 'repeat' THEN 'Already investigated ''' || target_entity
          || '''. Try a different entity.'
        WHEN inv_kind = 'honeypot' THEN '⚠️ Honeypot triggered: ''' || target_entity
          || ''' was a canary decoy. Penalty applied.'
        WHEN inv_kind = 'missing' THEN 'INVESTIGATE requires a target_entity.'
        WHEN inv_kind = 'effective' AND new_logs + new_entities = 0 THEN
          'Dead-end investigation: ''' || target_entity || ''' revealed nothing useful.'
        WHEN inv_kind = 'effective' THEN 'Investigated ''' || target_entity || '''. Found '
          || new_entities || ' new entities, ' || new_logs || ' new logs.'
        WHEN correct + false_positives + duplicates = 0 THEN 'No redactions provided.'
        ELSE correct || ' correct, ' || false_positives || ' false positives, ' || duplicates
          || ' duplicates.' END AS feedback,
      CASE WHEN terminated THEN final
        WHEN truncated THEN '⏰ Investigation budget exhausted. Auto-submitting findings.'
        WHEN action_type = 'scan' AND new_entities > 0 THEN 'Scan found ' || new_entities
          || ' new entities. ' || coalesce('Try investigating: ' || next_target, '')
        WHEN action_type = 'scan' THEN
          'No new entities found in visible logs. Try investigating known entities.'
        WHEN inv_kind = 'repeat' THEN '''' || target_entity
          || ''' was already investigated. Choose another entity.'
        WHEN inv_kind = 'honeypot' THEN 'Honeypot triggered. Avoid investigating obvious decoys.'
        WHEN inv_kind = 'missing' THEN 'Please provide a target_entity to investigate.'
        WHEN inv_kind = 'effective' AND new_logs + new_entities = 0 THEN '''' || target_entity
          || ''' was a dead-end. Prioritize other entities.'
        WHEN inv_kind = 'effective' THEN 'Investigation of ''' || target_entity || ''' revealed '
          || new_logs || ' new logs and ' || new_entities || ' entities.'
          || CASE WHEN new_secrets > 0 THEN ' 🔑 CRITICAL: Secret tokens discovered!' ELSE '' END
          || coalesce(' Next target suggestion: ' || next_suggestion, '')
        WHEN correct + false_positives + duplicates = 0 THEN 'Please provide redactions: '
          || '[{''original'': ''...'', ''type'': ''email|ip|username|token''}]'
        ELSE 'Redacted ' || correct || ' items correctly.'
          || CASE WHEN false_positives > 0 THEN ' ⚠️ ' || false_positives
            || ' false positives (penalty applied).' ELSE '' END
          || ' Coverage: ' || redacted_total || '/' || total_pii || ' ('
          || printf('%.0f', CAST(redacted_total AS DOUBLE) / total_pii * 100) || '%)'
          || CASE WHEN redacted_total = total_pii THEN
            ' 🎉 All PII found! Consider submitting.' ELSE '' END END AS hint
    FROM (SELECT *, '📊 Final Score: ' || printf('%.3f', submit_score) || ' | F1: '
        || printf('%.3f', f1_score) || ' | Discovery: ' || printf('%.0f', discovery_rate * 100)
        || '% | Redacted: ' || redacted_total || '/' || total_pii
        || CASE WHEN secrets_missed > 0 THEN ' | ⚠️ CRITICAL: ' || secrets_missed
          || ' secret(s) missed!' ELSE '' END AS final FROM results) r
    LEFT JOIN nexts n ON n.episode_id = r.episode_id AND n.step = r.step"""
on_replay("b21_step_feedback", W.step_feedback, FEEDBACK)
on_replay(
    "b22_success",
    lambda r: r.step_results.select(
        "episode_id", "step", S.success(
            F.when(c("terminated") | c("truncated"), c("f1_score"))).alias("success")),
    f"""SELECT episode_id, step, coalesce(CASE WHEN terminated OR truncated THEN f1_score END
      >= {dbl(0.7)}, false) AS success FROM results""",
)

def _answer():
    """Raw model answers made from recorded actions, in five shapes."""
    shape = (c("episode_id") * 3 + c("step")) % 5
    js = F.concat(
        F.lit('{"action": "'), F.upper("action_type"), F.lit('", "target": '),
        F.coalesce(F.concat(F.lit('"'), c("target_entity"), F.lit('"')), F.lit("null")),
        F.lit("}"),
    )
    return (
        F.when(shape == 0, js)
        .when(shape == 1, F.concat(F.lit("Sure:\n"), js, F.lit(" ok")))
        .when(shape == 2, F.lit('{"action": "delete", "target": "all"}'))
        .when(shape == 3, F.lit('{"action": "investigate", "target": null}'))
        .otherwise(F.concat(F.lit("I would "), c("action_type")))
    )


on_incident(
    "b23_parse_agent_json",
    lambda i: traces.parse_agent_json(
        i.actions.select("episode_id", "step", _answer().alias("answer"))
    ).drop("answer"),
    r"""SELECT episode_id, step,
      CASE WHEN error IS NULL THEN lower(json_extract_string(j, '$.action')) END AS action,
      CASE WHEN error IS NULL THEN json_extract_string(j, '$.target') END AS target,
      CASE WHEN error IS NULL THEN coalesce(json_extract_string(j, '$.reason'), '') END AS reason,
      error FROM (SELECT *, CASE WHEN j = '' THEN 'no_json'
        WHEN NOT json_valid(j) THEN 'bad_json'
        WHEN lower(json_extract_string(j, '$.action')) NOT IN
          ('scan', 'investigate', 'redact', 'submit') THEN 'bad_action'
        WHEN lower(json_extract_string(j, '$.action')) = 'investigate'
          AND coalesce(json_extract_string(j, '$.target'), '') = '' THEN 'no_target' END AS error
      FROM (SELECT episode_id, step, regexp_extract(answer, '(?s)\{.*\}', 0) AS j FROM (
        SELECT episode_id, step, CASE (episode_id * 3 + step) % 5 WHEN 0 THEN js
          WHEN 1 THEN 'Sure:' || chr(10) || js || ' ok'
          WHEN 2 THEN '{"action": "delete", "target": "all"}'
          WHEN 3 THEN '{"action": "investigate", "target": null}'
          ELSE 'I would ' || action_type END AS answer
        FROM (SELECT *, '{"action": "' || upper(action_type) || '", "target": '
          || coalesce('"' || target_entity || '"', 'null') || '}' AS js FROM actions))))""",
)
on_replay(
    "b24_observation_summary", W.observation_summary,
    """SELECT episode_id, step, 0 AS section, 'Visible logs: ' || visible_total AS text FROM results
      UNION ALL SELECT episode_id, step, 1, 'Steps remaining: ' || steps_remaining FROM results
      UNION ALL SELECT episode_id, step, 2, 'Coverage so far: ' || redacted_total || '/'
        || total_pii FROM results
      UNION ALL SELECT l.episode_id, l.step, 3, 'Discovered: ' || s.value FROM live l JOIN spans s
        ON s.episode_id = l.episode_id AND s.discovered_at <= l.step
      UNION ALL SELECT l.episode_id, l.step, 4, 'Targets: ' || s.value FROM live l JOIN spans s
        ON s.episode_id = l.episode_id AND s.discovered_at <= l.step
        AND (s.investigated_at IS NULL OR s.investigated_at > l.step)""",
)
