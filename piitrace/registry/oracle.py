"""SQL counterparts of the derived tables, as common table expressions.

``sql(body)`` puts in front of ``body`` the expressions it names, and theirs. They
follow the definitions step by step (logs times episodes, row by row), not the way
the Spark plans compute them.
"""

from __future__ import annotations

import re

from piitrace.functions.patterns import (
    BLOB_SECRET,
    EXCLUDED_IPS,
    MIN_TOKEN_LENGTH,
    PATTERNS,
    PROFILES,
    TOKEN_PATTERNS,
)
from piitrace.sources import dims, incident


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def rows(name: str, columns: str, values) -> str:
    cell = lambda v: "NULL" if v is None else lit(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in values)
    return f"SELECT * FROM (VALUES {body}) AS {name}({columns})"


def clamp(x: str, eps: float) -> str:
    return (f"greatest(CAST({eps} AS DOUBLE), least(CAST({1.0 - eps!r} AS DOUBLE), "
            f"coalesce(CAST({x} AS DOUBLE), CAST({eps} AS DOUBLE))))")


def c05(x: str) -> str:
    return clamp(x, 0.05)


def c01(x: str) -> str:
    return clamp(x, 0.01)


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def grade(x: str) -> str:
    tests = " ".join(
        f"WHEN {x} >= {dbl(f)} THEN '{g}'"
        for g, f in [("S", 0.95), ("A", 0.85), ("B", 0.70), ("C", 0.50), ("D", 0.30)]
    )
    return f"CASE {tests} ELSE 'F' END"


def fixed(x: str, places: int) -> str:
    return f"printf('%.{places}f', {x})"


def hits(pid: str, order: int, source: str, keys: str, text: str, profile: str,
         strict: bool = True) -> str:
    """Matches of one pattern as rows."""
    if pid == "E11":
        whole = "CASE WHEN length(b) % 4 = 0 THEN b END" if strict else (
            "rpad(rtrim(b, '='), CAST(ceil(length(rtrim(b, '=')) / 4) * 4 AS INT), '=')")
        return f"""
        SELECT {keys}, 'E11' AS pattern_id, {order} AS pattern_ord,
          CAST(row_number() OVER (PARTITION BY {keys} ORDER BY bi, si) - 1 AS INT) AS match_ord,
          'token' AS pii_type, v AS value
        FROM (SELECT {keys}, bi, unnest(m) AS v, generate_subscripts(m, 1) AS si FROM (
          SELECT {keys}, bi, regexp_extract_all(
            try(decode(from_base64({whole}))),
            {lit(BLOB_SECRET[profile])}, 1) AS m
          FROM (SELECT {keys}, unnest(bs) AS b, generate_subscripts(bs, 1) AS bi FROM (
            SELECT {keys}, regexp_extract_all({text}, {lit(PATTERNS['E10'].regex)}, 1) AS bs
            FROM {source}))))"""
    p = PATTERNS[pid]
    keep = "TRUE"
    if pid == "E2":
        keep = "v NOT IN (" + ", ".join(lit(x) for x in EXCLUDED_IPS[profile]) + ")"
    if pid in TOKEN_PATTERNS:
        keep = f"length(v) >= {MIN_TOKEN_LENGTH}"
    return f"""
    SELECT {keys}, '{pid}' AS pattern_id, {order} AS pattern_ord, CAST(i - 1 AS INT) AS match_ord,
      '{p.pii_type}' AS pii_type, v AS value
    FROM (SELECT {keys}, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM (
      SELECT {keys}, regexp_extract_all({text}, {lit(p.regex)}, {p.group}) AS m FROM {source}))
    WHERE {keep}"""


def all_hits(source: str, keys: str, text: str, profile: str) -> str:
    return " UNION ALL ".join(
        hits(pid, i, source, keys, text, profile) for i, pid in enumerate(PROFILES[profile])
    )


def _choose(values, index: str) -> str:
    return f"({listing(values)})[CAST({index} AS INT) + 1]"


_NAME = _choose(dims.NAMES, "(user_id * 7) % 32")
_TOKEN = """CASE (scenario_id + ord) % 5 WHEN 0 THEN 'sk_live_' || h[1:24]
  WHEN 1 THEN 'AKIA' || upper(h[1:16]) WHEN 2 THEN 'ghp_' || h[1:30]
  WHEN 3 THEN 'hf_' || h[1:30] ELSE 'api_key_' || h[1:20] END"""
_B64 = "base64(encode({}))"

_TEXTS = [
    "'ACCESS [turnstile]: door 2 let in user=' || username || ', reader ' || ip",
    "'MAIL: parcel notice for ' || email || ' came back'",
    "'[video] User ''' || username || ''' joined room Oak over ' || ip",
    "'TICKET [helpdesk]: ' || email || ' asks for a second screen'",
    "'PRINT_QUEUE [poster-print]: a job of ' || ip || ' waits for paper'",
    "'[canteen] the lunch card of ' || upper(username[1]) || username[2:] || ' is empty'",
    "'PAGE [wiki]: tutorial: write to test@example.com'",
    "'[wiki] picture 3 shows 127.0.0.1 as the host'",
    "'[wiki] sandbox login user=''admin'''",
    "'[drill] dial +33-142-868-2000 and hang up'",
    "'TEST [ci]: fixture 5 has sk_test_' || m[1:24]",
    "'[ci] snapshot b64=' || " + _B64.format("'mock_secret=abcd1234'"),
    "'DNS: resolvers 8.8.8.8 and 8.8.4.4 answer'",
    "'[lease] this node keeps ' || ip",
    "'[rotation] ' || CASE q % 7 WHEN 0 THEN 'ghp_' || m || 'abcd' WHEN 1 THEN 'hf_' || m || "
    "'ab' WHEN 2 THEN 'ASIA' || upper(m[1:16]) WHEN 3 THEN 'eyJ' || m || '.eyJ' || m || '.' || m "
    "WHEN 4 THEN 'xoxb-' || m WHEN 5 THEN m ELSE m || m[1:8] END || ' is void'",
    "'START [locker-room]: started with vendor_key=' || tok",
    "'[forms] visitor form 14 holds the text ' || tok",
    "'SECRET_VIEW [vault]: page shows sk_l**e_' || right(coalesce(token, '********'), 8)",
    "'[export] nightly b64=' || " + _B64.format("'token=' || tok"),
    "'CALL: ring ' || phone || ' when the crate is here'",
    "'[backup] ' || ip || ' copied 40 files'",
    "'BOOKING [travel]: ' || email || ' booked seat 12C from ' || ip",
    "'EXPORT: User ''' || username || ''' exported 17 rows'",
]
_MARKS = {
    "email": (1, 3, 21), "ip": (0, 2, 4, 20, 21), "username": (0, 2, 5, 22),
    "token": (15, 16, 17, 18), "phone": (19,),
}
#: A recorded step, by scenario: from 1 on, from 0 on with gaps, or as seconds.
_RECORDED = """CAST(CASE scenario_id % 3 WHEN 0 THEN step WHEN 1 THEN 3 * (step - 1)
  ELSE 1700000000 + 60 * step END AS INT)"""

CTES = {
    "cfg": rows("cfg", "difficulty, n_users, n_layers, budget, n_secrets, n_decoys, n_deadends",
                dims.DIFFICULTY_ROWS),
    "decoys": rows("decoys", "pii_type, value", [
        (k, v) for k, vs in dims.DECOY_VALUES.items() for v in vs]),
    "people": f"""
      SELECT *, {_NAME} AS username,
        {_NAME} || '.' || {_choose(['dev', 'ops', 'sec'], 'user_id % 3')} || '@'
          || {_choose(dims.DOMAINS, 'user_id % 8')} AS email,
        CASE user_id % 4 WHEN 0 THEN '10.' || (user_id % 256) || '.7.'
          WHEN 1 THEN '172.' || (16 + user_id % 16) || '.3.'
          WHEN 2 THEN '192.168.' || (user_id % 256) || '.' ELSE '203.0.113.' END
          || (1 + (user_id * 13) % 254) AS ip,
        CASE WHEN ord < n_secrets THEN {_TOKEN} END AS token,
        CASE WHEN ord < n_secrets THEN {_choose(
            ['stripe', 'aws_access', 'github', 'huggingface', 'generic_api'],
            '(scenario_id + ord) % 5')} END AS token_type,
        CASE user_id % 4 WHEN 0 THEN '+1-' || d3 || '-' || e3 || '-' || f4
          WHEN 1 THEN '+91-' || d3 || '00-' || e3 || '00'
          WHEN 2 THEN '+44-20-' || f4 || '-' || d3 || '0' ELSE '+1-555-' || f4 || '-' || d3 END
          AS phone,
        CASE WHEN ord = 0 THEN '+44-20-' || lpad(CAST(scenario_id % 10000 AS VARCHAR), 4, '0')
          || '-9' || e3 END AS phone2,
        {_choose(dims.SERVICES, 'user_id % 11')} AS service
      FROM (SELECT * REPLACE (CASE scenario_id % 7 WHEN 3 THEN 3 WHEN 4 THEN 10 WHEN 5 THEN 25
          ELSE budget END AS budget) FROM (
        SELECT user_id, user_id // 5 AS scenario_id, user_id % 5 AS ord,
          md5(CAST(user_id AS VARCHAR)) AS h,
          lpad(CAST(200 + user_id % 700 AS VARCHAR), 3, '0') AS d3,
          lpad(CAST(user_id * 7 % 1000 AS VARCHAR), 3, '0') AS e3,
          lpad(CAST(user_id * 37 % 10000 AS VARCHAR), 4, '0') AS f4,
          (['easy', 'medium', 'hard'])[CAST((user_id // 5) % 3 AS INT) + 1] AS difficulty
        FROM (SELECT DISTINCT user_id FROM events)) JOIN cfg USING (difficulty))
      WHERE ord < n_users""",
    "secrets": """SELECT scenario_id, 'secret_' || ord AS secret_id, token, token_type,
      username AS owner, service FROM people WHERE token IS NOT NULL""",
    "scenarios": "SELECT DISTINCT scenario_id, difficulty, n_layers, budget FROM people",
    "lines": f"""
      SELECT scenario_id, event_id AS log_id, CAST(CASE
          WHEN tmpl <= 5 THEN CASE WHEN ord < 2 THEN 0 ELSE 1 END
          WHEN tmpl <= 14 THEN 0
          WHEN tmpl <= 18 THEN greatest(1, n_layers - 1 - event_id % 2)
          WHEN tmpl = 19 THEN n_layers - 1
          ELSE 1 + q % (n_layers - 1) END AS INT) AS layer,
        strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE tmpl
          {' '.join(f'WHEN {i} THEN {t}' for i, t in enumerate(_TEXTS))} END AS line,
        tmpl, email, ip, username, token, phone, ts
      FROM (SELECT e.event_id, e.ts, e.event_id % 23 AS tmpl, e.event_id // 23 AS q,
          md5(CAST(e.event_id AS VARCHAR)) AS m, coalesce(p.token, 'none') AS tok, p.*
        FROM events e JOIN people p USING (user_id))""",
    "logs": "SELECT scenario_id, log_id, layer, line FROM lines",
    "log_pii": " UNION ALL ".join(
        f"SELECT scenario_id, log_id, '{k}' AS pii_type, {k} AS value FROM lines "
        f"WHERE tmpl IN ({', '.join(map(str, ts))}) AND {k} IS NOT NULL"
        for k, ts in _MARKS.items()),
    "truth": " UNION ".join(
        f"SELECT scenario_id, '{k}' AS pii_type, {c} AS value FROM people WHERE {c} IS NOT NULL"
        for k, c in [("username", "username"), ("email", "email"), ("ip", "ip"),
                     ("token", "token"), ("phone", "phone"), ("phone", "phone2")]),
    "flat": """SELECT scenario_id, value, max(CASE WHEN pii_type = 'token' THEN 1 ELSE 0 END)
      AS is_token FROM truth GROUP BY ALL""",
    "totals": """SELECT scenario_id, count(*) AS total_pii, CAST(sum(is_token) AS BIGINT)
      AS total_tokens FROM flat GROUP BY ALL""",
    "user_edges": " UNION ".join(
        f"SELECT scenario_id, {a} AS src, {b} AS dst FROM people"
        for a, b in [("username", "email"), ("username", "ip"), ("email", "username"),
                     ("email", "ip"), ("ip", "username"), ("ip", "email")]),
    "secret_edges": """SELECT scenario_id, username AS src, token AS dst FROM people
      WHERE token IS NOT NULL UNION SELECT scenario_id, ip, token FROM people
      WHERE token IS NOT NULL""",
    "edges": "SELECT * FROM user_edges UNION SELECT * FROM secret_edges",
    "honeypots": """SELECT scenario_id, v AS value FROM scenarios,
      (VALUES ('admin'), ('root'), ('test@example.com')) AS t(v)
      WHERE v <> 'test@example.com' OR difficulty <> 'easy'""",
    "plan": rows("plan", "strategy, step, action_type, t", incident.PLAN),
    "firsts": """SELECT scenario_id, max(CASE WHEN ord = 0 THEN username END) AS u0,
      max(CASE WHEN ord = 1 THEN ip END) AS i1, max(CASE WHEN ord = 1 THEN email END) AS e1
      FROM people GROUP BY ALL""",
    "actions": f"""SELECT scenario_id * 5 + strategy AS episode_id, scenario_id, strategy,
      {_RECORDED} AS step, action_type,
      CASE t WHEN 'U0' THEN u0 WHEN 'I1' THEN i1 WHEN 'E1' THEN e1 ELSE t END AS target_entity
      FROM firsts, plan""",
    "planted": rows("planted", "strategy, original, type", [
        (s, v, k) for s, items in incident.PLANTED.items() for v, k in items]),
    "redact_steps": rows("redact_steps", "strategy, step", incident.REDACT_STEP.items()),
    "owned": " UNION ALL ".join(
        f"SELECT scenario_id, ord, {k} AS original, '{k}' AS type FROM people "
        f"WHERE {k} IS NOT NULL" for k in ("username", "email", "ip", "token", "phone")),
    "redactions": f"""
      SELECT episode_id, step, CAST(row_number() OVER (PARTITION BY episode_id
        ORDER BY original, type) AS INT) AS pos, original, type
      FROM (SELECT scenario_id * 5 + strategy AS episode_id, {_RECORDED} AS step, original, type
        FROM (
          SELECT scenario_id, original, type, 0 AS strategy FROM owned
            WHERE ord < 1 AND type <> 'token'
          UNION ALL SELECT scenario_id, original, type, 1 FROM owned WHERE ord < 1
          UNION ALL SELECT scenario_id, original, type, 2 FROM owned WHERE type <> 'token'
          UNION ALL SELECT scenario_id, original, type, 3 FROM owned WHERE ord < 2
          UNION ALL SELECT scenario_id, original, type, 4 FROM owned WHERE type <> 'phone'
          UNION ALL SELECT scenario_id, original, type, strategy FROM scenarios, planted)
        JOIN redact_steps USING (strategy))""",
    # ---- replay
    "numbered": """SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY step) AS step_no
      FROM actions""",
    "ends": """SELECT episode_id, min(CASE WHEN action_type = 'submit' THEN step_no END) AS sub
      FROM numbered GROUP BY ALL""",
    "live": """SELECT n.episode_id, n.scenario_id, n.strategy, n.step AS recorded_step,
        CAST(n.step_no AS INT) AS step,
        n.action_type, n.target_entity, s.difficulty, s.n_layers, s.budget,
        n.action_type = 'submit' AS terminated,
        n.step_no = s.budget AND n.action_type <> 'submit' AS truncated,
        CAST(greatest(0, s.budget - n.step_no) AS INT) AS steps_remaining
      FROM numbered n JOIN ends USING (episode_id) JOIN scenarios s USING (scenario_id)
      WHERE n.step_no <= least(coalesce(ends.sub, s.budget), s.budget)""",
    "kinds": """SELECT l.*, CASE WHEN l.action_type <> 'investigate' THEN NULL
        WHEN coalesce(l.target_entity, '') = '' THEN 'missing'
        WHEN EXISTS (SELECT 1 FROM live p WHERE p.episode_id = l.episode_id AND p.step < l.step
          AND p.action_type = 'investigate' AND p.target_entity = l.target_entity) THEN 'repeat'
        WHEN EXISTS (SELECT 1 FROM honeypots h WHERE h.scenario_id = l.scenario_id
          AND h.value = l.target_entity) THEN 'honeypot' ELSE 'effective' END AS inv_kind
      FROM live l""",
    "search": """SELECT episode_id, scenario_id, step, target_entity AS value FROM kinds
        WHERE inv_kind = 'effective'
      UNION SELECT k.episode_id, k.scenario_id, k.step, e.dst FROM kinds k JOIN edges e
        ON e.scenario_id = k.scenario_id AND e.src = k.target_entity
        WHERE k.inv_kind = 'effective'""",
    "episodes": """SELECT episode_id, scenario_id, min(CASE WHEN action_type = 'scan' THEN step
      END) AS first_scan, max(step) AS steps_used FROM live GROUP BY ALL""",
    "vis": """SELECT e.episode_id, e.scenario_id, l.log_id, 0 AS visible_at
        FROM episodes e JOIN logs l USING (scenario_id) WHERE l.layer = 0
      UNION ALL SELECT s.episode_id, s.scenario_id, l.log_id, min(s.step)
        FROM search s JOIN log_pii p ON p.scenario_id = s.scenario_id AND p.value = s.value
        JOIN logs l ON l.log_id = p.log_id WHERE l.layer > 0 GROUP BY ALL""",
    "disc": """SELECT * FROM (SELECT v.episode_id, v.scenario_id, p.value,
        min(CASE WHEN v.visible_at = 0 THEN e.first_scan ELSE v.visible_at END) AS discovered_at
      FROM vis v JOIN log_pii p USING (log_id) JOIN episodes e
        ON e.episode_id = v.episode_id GROUP BY ALL) WHERE discovered_at IS NOT NULL""",
    "inv_at": """SELECT episode_id, scenario_id, target_entity AS value, step AS investigated_at
      FROM kinds WHERE inv_kind IN ('effective', 'honeypot')""",
    "matched": """SELECT r.episode_id, l.step, r.pos, r.original, r.type, l.scenario_id, f.value IS NOT NULL AS in_truth,
        coalesce(f.is_token, 0) = 1 AS is_token
      FROM redactions r JOIN live l ON l.episode_id = r.episode_id AND l.recorded_step = r.step
        AND l.action_type = 'redact'
      LEFT JOIN flat f ON f.scenario_id = l.scenario_id AND f.value = r.original""",
    "outcomes": """SELECT *, CASE WHEN NOT in_truth THEN 'false_positive'
      WHEN row_number() OVER (PARTITION BY episode_id, original ORDER BY step, pos) = 1
      THEN 'correct' ELSE 'duplicate' END AS outcome FROM matched""",
    "red_counts": """SELECT episode_id, step,
        count(*) FILTER (outcome = 'correct') AS correct,
        count(*) FILTER (outcome = 'false_positive') AS false_positives,
        count(*) FILTER (outcome = 'duplicate') AS duplicates,
        count(*) FILTER (outcome = 'correct' AND is_token) AS secrets_redacted
      FROM outcomes GROUP BY ALL""",
    "red_at": """SELECT episode_id, scenario_id, original AS value, min(step) AS redacted_at,
      bool_or(is_token) AS is_token FROM matched WHERE in_truth GROUP BY ALL""",
    "counted": """SELECT k.*,
        coalesce((SELECT count(*) FROM vis v WHERE v.episode_id = k.episode_id
          AND v.visible_at = k.step), 0) AS new_logs,
        coalesce((SELECT count(*) FROM disc d WHERE d.episode_id = k.episode_id
          AND d.discovered_at = k.step), 0) AS new_entities,
        coalesce((SELECT count(*) FROM disc d JOIN flat f ON f.scenario_id = d.scenario_id AND
          f.value = d.value AND f.is_token = 1 WHERE d.episode_id = k.episode_id
          AND d.discovered_at = k.step), 0) AS new_secrets,
        coalesce((SELECT count(*) FROM disc d JOIN flat f ON f.scenario_id = d.scenario_id AND
          f.value = d.value WHERE d.episode_id = k.episode_id
          AND d.discovered_at = k.step), 0) AS new_true,
        coalesce(r.correct, 0) AS correct, coalesce(r.false_positives, 0) AS false_positives,
        coalesce(r.duplicates, 0) AS duplicates,
        coalesce(r.secrets_redacted, 0) AS secrets_redacted,
        coalesce((SELECT count(*) FROM vis v WHERE v.episode_id = k.episode_id
          AND v.visible_at = 0), 0) AS surface_logs,
        t.total_pii, t.total_tokens
      FROM kinds k LEFT JOIN red_counts r ON r.episode_id = k.episode_id AND r.step = k.step
      JOIN totals t ON t.scenario_id = k.scenario_id""",
    "running": """SELECT *,
        CAST(surface_logs + sum(new_logs) OVER w AS BIGINT) AS visible_total,
        CAST(sum(new_entities) OVER w AS BIGINT) AS discovered_total,
        CAST(sum(new_true) OVER w AS BIGINT) AS discovered_truth,
        CAST(sum(correct) OVER w AS BIGINT) AS redacted_total,
        CAST(total_tokens - sum(secrets_redacted) OVER w AS BIGINT) AS secrets_missed
      FROM counted WINDOW w AS (PARTITION BY episode_id ORDER BY step)""",
    "rated": f"""SELECT *,
        CASE WHEN redacted_total > 0 THEN {dbl(0.95)} ELSE {dbl(0.05)} END AS precision,
        {c05('CAST(redacted_total AS DOUBLE) / total_pii')} AS recall,
        {c05('CAST(discovered_truth AS DOUBLE) / total_pii')} AS discovery_rate,
        {c05('CAST(0.05 AS DOUBLE) * greatest(0, budget - step)')} AS efficiency_bonus,
        {dbl(-0.3)} * CAST(least(secrets_missed, 3) AS DOUBLE) AS secret_penalty
      FROM running""",
    "f1s": f"""SELECT *, {c05('CAST(2.0 AS DOUBLE) * precision * recall / (precision + recall)')}
      AS f1_score FROM rated""",
    "scored": f"""SELECT *, {c05(
        'f1_score * CAST(0.7 AS DOUBLE) + discovery_rate * CAST(0.2 AS DOUBLE) + '
        'recall * CAST(0.1 AS DOUBLE) + efficiency_bonus + secret_penalty')} AS submit_score,
        {c05('CAST(0.1 AS DOUBLE) * new_entities')} AS scan_reward,
        {c05('CAST(0.15 AS DOUBLE) * new_entities')} AS inv_bonus,
        {c05('CAST(correct AS DOUBLE) / total_pii')} AS red_score,
        CASE WHEN secrets_redacted > 0 THEN {c05('CAST(0.2 AS DOUBLE) * secrets_redacted')}
          ELSE {dbl(0.05)} END AS red_bonus,
        {dbl(-0.25)} * CAST(least(false_positives, 4) AS DOUBLE) AS red_penalty,
        {c05('CAST(redacted_total AS DOUBLE) / total_pii')} AS coverage
      FROM f1s""",
    "parts": f"""SELECT *,
        CASE WHEN inv_kind IN ('missing', 'repeat') THEN {dbl(0.05)}
          WHEN inv_kind = 'honeypot' THEN {dbl(-0.5)}
          WHEN new_logs = 0 AND new_entities = 0 THEN {dbl(0.05)}
          WHEN new_secrets > 0 THEN {c05('inv_bonus + CAST(0.3 AS DOUBLE) * new_secrets')}
          ELSE inv_bonus END AS investigate_reward,
        CASE WHEN correct + false_positives + duplicates = 0 THEN {dbl(0.05)}
          ELSE {c05('red_score + red_penalty + red_bonus')} END AS redact_reward
      FROM scored""",
    "results": f"""SELECT *, CASE WHEN terminated OR truncated THEN submit_score
        WHEN action_type = 'scan' THEN scan_reward
        WHEN action_type = 'investigate' THEN investigate_reward
        WHEN action_type = 'redact' THEN redact_reward ELSE {dbl(0.05)} END AS reward
      FROM parts""",
    "totalled": f"""SELECT *, list_reduce(list(reward) OVER (PARTITION BY episode_id
        ORDER BY step), lambda a, x: {c05('a + x')}, {dbl(0.05)}) AS cumulative_reward
      FROM results""",
    "finals": f"""SELECT *, {grade('submit_score')} AS grade FROM results
      WHERE terminated OR truncated""",
    "runs": f"""SELECT episode_id, difficulty, strategy, scenario_id AS seed, step AS steps,
        {c01('submit_score')} AS total_score, {c01('f1_score')} AS f1_score,
        {c01('discovery_rate')} AS discovery_rate, precision, grade,
        redacted_total AS true_positives, {c01('f1_score')} >= {dbl(0.7)} AS success
      FROM finals""",
    "spans": """SELECT d.*, i.investigated_at, r.redacted_at FROM disc d
      LEFT JOIN inv_at i ON i.episode_id = d.episode_id AND i.value = d.value
      LEFT JOIN red_at r ON r.episode_id = d.episode_id AND r.value = d.value""",
    "nexts": """SELECT l.episode_id, l.step, min(s.value) AS next_target,
        min(CASE WHEN s.redacted_at IS NULL OR s.redacted_at > l.step THEN s.value END)
          AS next_suggestion, count(*) AS n_targets
      FROM live l JOIN spans s ON s.episode_id = l.episode_id AND s.discovered_at <= l.step
        AND (s.investigated_at IS NULL OR s.investigated_at > l.step) GROUP BY ALL""",
    # ---- texts
    "corpus": """SELECT 'log' AS src, log_id AS id, line AS text FROM logs
      UNION ALL SELECT 'document', doc_id, text FROM documents
      UNION ALL SELECT 'page', page_id, html FROM pages
      UNION ALL SELECT 'turn', conv_id * 100000 + turn, text FROM conversations""",
    "demo_hits": all_hits("logs", "scenario_id, log_id", "line", "demo"),
    "server_hits": all_hits("logs", "scenario_id, log_id", "line", "server"),
    "demo_doc_hits": all_hits("documents", "doc_id", "text", "demo"),
    "demo_found": """SELECT * EXCLUDE rn FROM (SELECT scenario_id, value, log_id, pattern_id,
      pii_type, row_number() OVER (PARTITION BY scenario_id, value
        ORDER BY log_id, pattern_ord, match_ord) AS rn FROM demo_hits) WHERE rn = 1""",
    "server_found": """SELECT * EXCLUDE rn FROM (SELECT scenario_id, value, log_id, pattern_id,
      pii_type, row_number() OVER (PARTITION BY scenario_id, value
        ORDER BY log_id, pattern_ord, match_ord) AS rn FROM server_hits) WHERE rn = 1""",
    "entity_values": """SELECT DISTINCT value FROM (SELECT value FROM log_pii UNION ALL
      SELECT value FROM demo_hits UNION ALL SELECT original FROM redactions UNION ALL
      SELECT value FROM truth UNION ALL SELECT value FROM demo_doc_hits)""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with the expressions it needs in front, each before its users."""
    known = {**CTES, **extra}
    words = re.compile(r"\b(" + "|".join(sorted(known, key=len, reverse=True)) + r")\b")
    placed: list[str] = []

    def place(text: str, inside: tuple[str, ...]) -> None:
        for name in dict.fromkeys(words.findall(re.sub(r"'[^']*'", "''", text))):
            if name not in placed and name not in inside:
                place(known[name], (*inside, name))
                placed.append(name)

    place(body, ())
    if not placed:
        return body
    # a table several others read is computed once
    return "WITH " + ", ".join(
        f"{n} AS MATERIALIZED ({known[n]})" for n in placed
    ) + " " + body
