"""Redaction, scoring and summary queries (R, S, G) and the grader's feedback (B20)."""

from pyspark.sql import functions as F

from piitrace.operators import extract as X
from piitrace.operators import redaction as R
from piitrace.operators import scoring as S
from piitrace.operators import summary as M
from piitrace.plans import replay as W
from piitrace.registry.base import add, on_incident, on_replay, replay
from piitrace.registry.oracle import c01, c05, dbl, grade
from piitrace.sources import traces

c = F.col

# ---- R

on_replay(
    "r1_match_redactions",
    lambda r: r.matched.select("episode_id", "step", "pos", "original", "in_truth", "is_token"),
    "SELECT episode_id, step, pos, original, in_truth, is_token FROM matched",
)
on_replay(
    "r2_mark_dups",
    lambda r: R.mark_dups(r.matched).select("episode_id", "step", "pos", "original", "outcome"),
    "SELECT episode_id, step, pos, original, outcome FROM outcomes",
)
on_replay("r3_redact_counts", lambda r: R.redact_counts(r.folded), "SELECT * FROM red_counts")
on_replay(
    "r4_redact_reward",
    lambda r: r.step_results.filter("action_type = 'redact'").select(
        "episode_id", "step", "redact_reward"),
    "SELECT episode_id, step, redact_reward FROM parts WHERE action_type = 'redact'",
)


def _coverage(r):
    counts = r.live.select("episode_id", "scenario_id", "step").join(
        R.redact_counts(r.folded).select("episode_id", "step", "correct"),
        ["episode_id", "step"], "left").fillna(0, subset=["correct"])
    return R.coverage(counts, r.totals).select("episode_id", "step", "redacted_total", "coverage")


on_replay("r5_coverage", _coverage,
          "SELECT episode_id, step, redacted_total, coverage FROM parts")


def _pred(i):
    return X.extract_pii(i.logs, profile="demo").select("scenario_id", "value")


on_incident(
    "r6_confusion", lambda i: S.confusion(_pred(i), i.truth, ["scenario_id"]),
    """SELECT scenario_id, count(*) FILTER (p AND t) AS true_positives,
      count(*) FILTER (p AND NOT t) AS false_positives,
      count(*) FILTER (t AND NOT p) AS false_negatives FROM (
        SELECT coalesce(d.scenario_id, f.scenario_id) AS scenario_id, d.value IS NOT NULL AS p,
          f.value IS NOT NULL AS t FROM demo_found d FULL JOIN flat f
          ON f.scenario_id = d.scenario_id AND f.value = d.value) GROUP BY ALL""",
)
on_replay(
    "r7_discovered_correct",
    lambda r: S.discovered_correct(r.discovered_at, r.truth, ["episode_id"], ["scenario_id"]),
    """SELECT d.episode_id, count(*) AS discovered_correct FROM disc d JOIN flat f
      ON f.scenario_id = d.scenario_id AND f.value = d.value GROUP BY ALL""",
)


def _tokens(r):
    return r.truth.filter("pii_type = 'token'").join(
        r.live.select("episode_id", "scenario_id").distinct(), "scenario_id")


on_replay(
    "r8_secret_counts",
    lambda r: S.secret_counts(_tokens(r), r.matched.withColumnRenamed("original", "value"),
                              ["episode_id"]),
    """SELECT e.episode_id, count(m.original) AS secrets_found,
      count(*) - count(m.original) AS secrets_missed, count(*) AS secrets_total
      FROM episodes e JOIN flat f ON f.scenario_id = e.scenario_id AND f.is_token = 1
      LEFT JOIN (SELECT DISTINCT episode_id, original FROM matched) m
        ON m.episode_id = e.episode_id AND m.original = f.value GROUP BY ALL""",
)


def _cases(r):
    """Grader input per ended episode."""
    rows = lambda df, col="value": df.select("episode_id", c(col).alias("value"))
    ended = r.episode_scores.select("episode_id", "scenario_id", c("step").alias("steps_used"),
                                    c("budget").alias("steps_budget"))
    flat = r.truth.select("scenario_id", "value", "pii_type").join(
        ended.select("episode_id", "scenario_id"), "scenario_id")
    return S.grader_counts(
        ended.drop("scenario_id"), rows(r.matched, "original"), rows(flat),
        rows(r.discovered_at), rows(flat.filter("pii_type = 'token'")), ["episode_id"],
    )


_CASES = """SELECT e.episode_id, e.step AS steps_used, e.budget AS steps_budget,
  (SELECT count(*) FROM (SELECT original FROM matched m WHERE m.episode_id = e.episode_id INTERSECT
    SELECT value FROM flat f WHERE f.scenario_id = e.scenario_id)) AS true_positives,
  (SELECT count(*) FROM (SELECT original FROM matched m WHERE m.episode_id = e.episode_id EXCEPT
    SELECT value FROM flat f WHERE f.scenario_id = e.scenario_id)) AS false_positives,
  (SELECT count(*) FROM (SELECT value FROM flat f WHERE f.scenario_id = e.scenario_id EXCEPT
    SELECT original FROM matched m WHERE m.episode_id = e.episode_id)) AS false_negatives,
  (SELECT count(*) FROM disc d JOIN flat f ON f.scenario_id = d.scenario_id AND f.value = d.value
    WHERE d.episode_id = e.episode_id) AS discovered_count,
  (SELECT count(DISTINCT original) FROM matched m WHERE m.episode_id = e.episode_id AND m.is_token)
    AS secrets_found,
  t.total_tokens - (SELECT count(DISTINCT original) FROM matched m
    WHERE m.episode_id = e.episode_id AND m.is_token) AS secrets_missed,
  t.total_tokens AS secrets_total, t.total_pii
  FROM finals e JOIN totals t USING (scenario_id)"""
on_replay("r6_grader_counts", _cases, "SELECT * FROM cases", cases=_CASES)
_PRF = """SELECT *, {f1} AS f1_score FROM (SELECT *, {p} AS precision, {r} AS recall FROM {src})"""
_PRF01 = _PRF.format(
    src="cases", p=c01("true_positives / CAST(nullif(true_positives + false_positives, 0) "
                       "AS DOUBLE)"),
    r=c01("true_positives / CAST(nullif(total_pii, 0) AS DOUBLE)"),
    f1=c01("CAST(2.0 AS DOUBLE) * precision * recall / (precision + recall)"),
)
_PRF05 = _PRF.format(
    src="cases", p=c05("true_positives / CAST(nullif(true_positives + false_positives, 0) "
                       "AS DOUBLE)"),
    r=c05("true_positives / CAST(nullif(total_pii, 0) AS DOUBLE)"),
    f1=c05("CAST(2.0 AS DOUBLE) * precision * recall / (precision + recall)"),
)
for _name, _eps, _body in [("env", 0.05, _PRF05), ("grader", 0.01, _PRF01)]:
    on_replay(
        f"r9_prf_{_name}",
        lambda r, e=_eps: S.prf(_cases(r), e).select("episode_id", "precision", "recall",
                                                     "f1_score"),
        f"SELECT episode_id, precision, recall, f1_score FROM ({_body})", cases=_CASES,
    )
on_replay(
    "r10_discovery_rate",
    lambda r: _cases(r).select(
        "episode_id",
        S.discovery_rate(c("discovered_count"), c("total_pii"), 0.05).alias("env"),
        S.discovery_rate(c("discovered_count"), c("total_pii"), 0.01).alias("grader")),
    f"""SELECT episode_id, {c05('discovered_count / CAST(total_pii AS DOUBLE)')} AS env,
      {c01('discovered_count / CAST(total_pii AS DOUBLE)')} AS grader FROM cases""", cases=_CASES,
)
on_replay(
    "r11_efficiency_env",
    lambda r: r.live.select("episode_id", "step", S.eff_env(c("budget"), c("step")).alias("eff")),
    f"""SELECT episode_id, step, {c05('CAST(0.05 AS DOUBLE) * greatest(0, budget - step)')} AS eff
      FROM live""",
)
on_replay(
    "r12_efficiency_grader",
    lambda r: r.live.select("episode_id", "step",
                            S.eff_grader(c("budget"), c("step")).alias("eff")),
    f"""SELECT episode_id, step, {c01('greatest(0, budget - step) / CAST(budget AS DOUBLE)')}
      AS eff FROM live""",
)
on_replay(
    "r13_secret_penalty",
    lambda r: r.step_results.select(
        "episode_id", "step", S.secret_penalty(c("secrets_missed"), "env").alias("env"),
        S.secret_penalty(c("secrets_missed"), "grader").alias("grader")),
    f"""SELECT episode_id, step, secret_penalty AS env,
      {dbl(-0.2)} * CAST(secrets_missed AS DOUBLE) AS grader FROM results""",
)

# ---- S

ENV_COLUMNS = ["episode_id", "precision", "recall", "f1_score", "discovery_rate",
               "efficiency_bonus", "secrets_missed", "true_positives", "false_positives",
               "false_negatives", "steps_used", "steps_budget", "total_score", "total_pii",
               "grade"]


def _env(r):
    last = r.step_counts.filter("terminated or truncated").withColumn("steps_used", c("step"))
    return S.score_env(last)


on_replay(
    "s1_score_env", lambda r: _env(r).select(*ENV_COLUMNS),
    """SELECT episode_id, precision, recall, f1_score, discovery_rate, efficiency_bonus,
      secrets_missed, redacted_total AS true_positives, 0 AS false_positives,
      total_pii - redacted_total AS false_negatives, step AS steps_used, budget AS steps_budget,
      submit_score AS total_score, total_pii, grade FROM finals""",
)
GRADER_COLUMNS = [
    "precision", "recall", "f1_score", "discovery_rate", "efficiency", "f1_component",
    "discovery_component", "recall_component", "efficiency_bonus", "total_score",
    "discovered_count", "steps_saved", "secrets_found", "secrets_missed", "secrets_total",
    "true_positives", "false_positives", "false_negatives", "total_pii", "grade",
]


def _graded(prf):
    score = c01("f1_component + discovery_component + recall_component + efficiency_bonus + "
                "CAST(-0.2 AS DOUBLE) * CAST(secrets_missed AS DOUBLE)")
    return f"""SELECT *, {grade('total_score')} AS grade FROM (SELECT *, {score} AS total_score
      FROM (SELECT *, {c01('f1_score * CAST(0.7 AS DOUBLE)')} AS f1_component,
        {c01('discovery_rate * CAST(0.2 AS DOUBLE)')} AS discovery_component,
        {c01('recall * CAST(0.1 AS DOUBLE)')} AS recall_component,
        {c01('efficiency * CAST(0.05 AS DOUBLE)')} AS efficiency_bonus
      FROM (SELECT *, {c01('discovered_count / CAST(nullif(total_pii, 0) AS DOUBLE)')}
          AS discovery_rate,
        greatest(0, steps_budget - steps_used) AS steps_saved,
        {c01('greatest(0, steps_budget - steps_used) / CAST(steps_budget AS DOUBLE)')}
          AS efficiency FROM ({prf}))))"""


_GRADED = _graded(_PRF01)
on_replay(
    "s2_score_grader", lambda r: r.graded.select("episode_id", *GRADER_COLUMNS),
    f"SELECT episode_id, {', '.join(GRADER_COLUMNS)} FROM graded", cases=_CASES, graded=_GRADED,
)


def _line_cases(i):
    """Every log line as a case: labels are the truth, the extractor's values the answer.
    Lines without a label have an empty truth."""
    found = X.first_seen(X.all_matches(i.logs), ("log_id",))
    return S.grader_counts(
        i.logs.select("log_id", c("layer").alias("steps_used"), F.lit(4).alias("steps_budget")),
        found, i.log_pii, found, i.log_pii.filter("pii_type = 'token'"), ["log_id"],
    )


_LINE_CASES = """SELECT l.log_id, l.layer AS steps_used, 4 AS steps_budget,
    coalesce(tp, 0) AS true_positives, coalesce(fp, 0) AS false_positives,
    coalesce(fn, 0) AS false_negatives, coalesce(tp, 0) AS discovered_count,
    coalesce(sf, 0) AS secrets_found, coalesce(sm, 0) AS secrets_missed,
    coalesce(sf, 0) + coalesce(sm, 0) AS secrets_total, coalesce(tp, 0) + coalesce(fn, 0)
      AS total_pii
  FROM logs l LEFT JOIN (SELECT coalesce(d.log_id, p.log_id) AS log_id,
      count(*) FILTER (d.value IS NOT NULL AND p.value IS NOT NULL) AS tp,
      count(*) FILTER (p.value IS NULL) AS fp, count(*) FILTER (d.value IS NULL) AS fn,
      count(*) FILTER (p.pii_type = 'token' AND d.value IS NOT NULL) AS sf,
      count(*) FILTER (p.pii_type = 'token' AND d.value IS NULL) AS sm
    FROM (SELECT DISTINCT log_id, value FROM demo_hits) d
    FULL JOIN (SELECT DISTINCT log_id, pii_type, value FROM log_pii) p
      ON p.log_id = d.log_id AND p.value = d.value GROUP BY ALL) n USING (log_id)"""
_NEUTRAL = ", ".join(
    f"CASE WHEN total_pii = 0 THEN 0.5 ELSE {x} END AS {x}" for x in GRADER_COLUMNS[:10]
) + ", " + ", ".join(
    f"CASE WHEN total_pii = 0 THEN 0 ELSE {x} END AS {x}" for x in
    ["discovered_count", "secrets_found", "secrets_missed", "secrets_total", "true_positives",
     "false_positives", "false_negatives"]
) + ", steps_saved, total_pii, CASE WHEN total_pii = 0 THEN 'C' ELSE grade END AS grade"
on_incident(
    "s3_score_grader_lines",
    lambda i: S.score_grader(_line_cases(i)).select("log_id", *GRADER_COLUMNS),
    f"SELECT log_id, {_NEUTRAL} FROM graded",
    cases=_LINE_CASES, graded=_GRADED,
)
on_replay(
    "s4_audit_grader",
    lambda r: S.audit_bounds(r.graded, S.GRADER_SCORES, 0.01),
    " UNION ALL ".join(
        f"""SELECT '{x}' AS field, count(*) AS checked, count(*) FILTER ({x} IS NULL
        OR {x} < {dbl(0.01)} OR {x} > {dbl(0.99)}) AS out_of_bounds, min({x}) AS min_score,
        max({x}) AS max_score FROM graded""" for x in S.GRADER_SCORES),
    cases=_CASES, graded=_GRADED,
)
_ENV_SCORES = ["precision", "recall", "f1_score", "discovery_rate", "efficiency_bonus",
               "submit_score", "coverage", "reward", "scan_reward", "redact_reward"]
on_replay(
    "s4_audit_env",
    lambda r: S.audit_bounds(r.step_results, _ENV_SCORES, 0.05, ()),
    " UNION ALL ".join(
        f"""SELECT '{x}' AS field, count(*) AS checked, count(*) FILTER ({x} IS NULL
        OR {x} < {dbl(0.05)} OR {x} > {dbl(0.95)}) AS out_of_bounds, min({x}) AS min_score,
        max({x}) AS max_score FROM results""" for x in _ENV_SCORES),
)
on_replay(
    "b20_grader_feedback",
    lambda r: S.grader_feedback(r.graded).select("episode_id", "feedback"),
    """SELECT episode_id, 'Grade: ' || grade || ' (' || printf('%.1f', total_score * 100) || '%)'
      || ' | Redaction accuracy: ' || CASE WHEN f1_score >= 0.95 THEN 'Outstanding.'
        WHEN f1_score >= 0.8 THEN 'Strong. Minor improvements possible.'
        WHEN f1_score >= 0.6 THEN 'Moderate. Missed several items.'
        ELSE 'Needs significant improvement.' END
      || ' | Investigation depth: ' || CASE WHEN discovery_rate < 0.5 THEN 'Shallow ('
          || printf('%.0f', discovery_rate * 100) || '%). Explore more entities.'
        WHEN discovery_rate < 0.8 THEN 'Moderate (' || printf('%.0f', discovery_rate * 100)
          || '%). Go deeper.'
        ELSE 'Thorough (' || printf('%.0f', discovery_rate * 100) || '%).' END
      || CASE WHEN secrets_missed > 0 THEN ' | ⚠️ CRITICAL: ' || secrets_missed
          || ' secret(s) missed! Heavy penalty applied.'
        WHEN secrets_total > 0 THEN ' | ✅ All ' || secrets_total
          || ' secret(s) found and redacted.' ELSE '' END
      || CASE WHEN steps_saved > 2 THEN ' | Efficient: ' || steps_saved
          || ' steps saved (bonus applied).' ELSE '' END AS feedback FROM graded""",
    cases=_CASES, graded=_GRADED,
)

# ---- G


def _runs(r):
    return M.episode_results(r.episode_scores)


_MEANS = """count(*) AS runs, round(avg(f1_score), 9) AS mean_f1,
  round(avg(total_score), 9) AS mean_score, round(stddev_pop(total_score), 9) AS std_score"""
on_replay("g1_benchmark_summary", lambda r: M.benchmark_summary(_runs(r)),
          f"SELECT {_MEANS} FROM runs")
on_replay("g2_benchmark_by_difficulty", lambda r: M.benchmark_by(_runs(r)),
          f"SELECT coalesce(difficulty, 'all') AS difficulty, {_MEANS} FROM runs "
          "GROUP BY ROLLUP (difficulty)")
on_replay(
    "g3_run_table", lambda r: M.run_table(_runs(r)),
    """SELECT difficulty, seed, strategy, steps, f1_score, discovery_rate, total_score,
      CASE WHEN success THEN 'PASS' ELSE 'FAIL' END AS status FROM runs""",
)
on_replay(
    "g4_strategy_summary", lambda r: M.strategy_summary(_runs(r)),
    """SELECT strategy, round(avg(total_score), 9) AS mean_score,
      round(avg(discovery_rate), 9) AS mean_discovery, round(avg(precision), 9) AS mean_precision
      FROM runs GROUP BY ALL""",
)
on_replay(
    "g5_kpis", lambda r: M.kpis(_runs(r)),
    """SELECT round(avg(f1_score), 9) AS avg_f1, round(avg(discovery_rate), 9) AS avg_discovery,
      substr('SABCDF', min(instr('SABCDF', grade)), 1) AS best_grade,
      CAST(sum(true_positives) AS BIGINT) AS pii_found, CAST(sum(steps) AS BIGINT) AS total_steps
      FROM runs""",
)
on_replay(
    "g6_fallback_scores",
    lambda r: M.fallback_scores(traces.parse_ends(traces.format_trace(r.step_results))).select(
        "file", F.round("printed_score", 9).alias("printed_score"),
        F.round("returned_score", 9).alias("returned_score")),
    f"""SELECT CAST(episode_id AS VARCHAR) AS file,
      round({c01('avg(rounded)')}, 9) AS printed_score,
      round({c01('sum(rounded)')}, 9) AS returned_score FROM (SELECT *,
        CAST(printf('%.2f', {c01('reward')}) AS DOUBLE) AS rounded FROM results) GROUP BY episode_id
    """,
)
on_replay(
    "g7_sorted_set",
    lambda r: M.sorted_set(r.discovered_at, ["episode_id"], "value"),
    "SELECT DISTINCT episode_id, value FROM disc ORDER BY ALL",
)
on_replay(
    "g8_next_target",
    lambda r: M.next_target(
        W.entity_spans(r).filter("investigated_at is null"), ["episode_id"]),
    """SELECT episode_id, min(value) AS next_target FROM spans WHERE investigated_at IS NULL
      GROUP BY ALL""",
)


def _mix(i):
    damaged = F.when((c("episode_id") + c("step")) % 11 == 0, "delete").otherwise(c("action_type"))
    return M.action_mix(i.actions.withColumn("action_type", damaged), ["strategy"])


on_incident(
    "g9_action_mix", _mix,
    """SELECT strategy, count(*) FILTER (a = 'scan') AS scan,
      count(*) FILTER (a = 'investigate') AS investigate, count(*) FILTER (a = 'redact') AS redact,
      count(*) FILTER (a = 'submit') AS submit, count(*) FILTER (a = 'delete') AS rejected
      FROM (SELECT *, CASE WHEN (episode_id + step) % 11 = 0 THEN 'delete' ELSE action_type END
        AS a FROM actions) GROUP BY ALL""",
)
on_replay(
    "g10_trace_total", lambda r: M.trace_total(r.step_results),
    """SELECT episode_id, round(sum(round_even(reward, 3)), 6) AS total_reward FROM results
      GROUP BY ALL""",
)
add(
    "flagship_episode_scores",
    lambda spark, folder: replay(spark, folder).episode_scores.select(
        "episode_id", "difficulty", "strategy", "step", "submit_score", "f1_score",
        "discovery_rate", "cumulative_reward", "grade"),
    """SELECT t.episode_id, t.difficulty, t.strategy, t.step, t.submit_score, t.f1_score,
      t.discovery_rate, t.cumulative_reward, f.grade FROM totalled t JOIN finals f
      ON f.episode_id = t.episode_id AND f.step = t.step""",
)
