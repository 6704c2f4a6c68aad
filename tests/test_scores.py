"""Golden grader cases and one-row rule cases."""

import pytest
from pyspark.sql import functions as F

from piitrace import schemas
from piitrace.functions import entities, scores
from piitrace.operators import extract, graph, redaction, scoring, summary
from piitrace.sources import readers, traces

CASES = [
    (1, ["email1", "email2", "ip1", "token1"], ["email1", "email2", "ip1", "token1"],
     ["email1", "email2", "ip1", "token1"], 2, 10, ["token1"]),
    (2, ["email1", "ip1"], ["email1", "email2", "ip1", "token1"], ["email1", "ip1"], 8, 10,
     ["token1"]),
    (3, [], ["email1", "email2", "ip1", "token1"], ["email1", "email2", "ip1", "token1"], 10, 10,
     ["token1"]),
    (4, ["bad1", "bad2", "bad3"], ["email1", "email2"], ["bad1", "bad2", "bad3"], 5, 10, []),
    (5, ["email1", "bad"], ["email1", "email2", "ip1"], ["email1", "email2"], 6, 10, ["email1"]),
    (6, [], [], [], 0, 10, []),
]
GOLDEN = {
    1: (.99, .99, .99, .99, .8, .693, .198, .099, .04, .99, "S", 4, 0, 0, 0),
    2: (.99, .5, .66443, .5, .2, .465101, .1, .05, .01, .425101, "D", 2, 0, 2, 1),
    3: (.01, .01, .01, .99, .01, .01, .198, .01, .01, .028, "F", 0, 0, 4, 1),
    4: (.01, .01, .01, .01, .5, .01, .01, .01, .025, .055, "F", 0, 3, 2, 0),
    5: (.5, .333333, .4, .666667, .4, .28, .133333, .033333, .02, .466667, "D", 1, 1, 2, 0),
    6: (.5, .5, .5, .5, .5, .5, .5, .5, .5, .5, "C", 0, 0, 0, 0),
}
FIELDS = ["precision", "recall", "f1_score", "discovery_rate", "efficiency", "f1_component",
          "discovery_component", "recall_component", "efficiency_bonus", "total_score", "grade",
          "true_positives", "false_positives", "false_negatives", "secrets_missed"]


@pytest.fixture(scope="module")
def graded(spark):
    df = spark.createDataFrame(CASES, schemas.GRADER_INPUT)
    return scoring.score_grader(
        scoring.grader_counts(**scoring.explode_cases(df), case=["case_id"])
    ).cache()


def test_golden_grader_cases(graded):
    for r in graded.collect():
        got = tuple(round(x, 6) if isinstance(x, float) else x for x in (r[f] for f in FIELDS))
        assert got == GOLDEN[r.case_id]


def test_grader_bounds_and_feedback(graded):
    audit = scoring.audit_bounds(graded, scoring.GRADER_SCORES, 0.01).collect()
    assert len(audit) == 10 and all(r.checked == 6 and r.out_of_bounds == 0 for r in audit)
    text = {r.case_id: r.feedback for r in scoring.grader_feedback(graded).collect()}
    assert text[1].startswith("Grade: S (99.0%) | Redaction accuracy: Outstanding.")
    assert "1 secret(s) missed" in text[2] and text[1].endswith("8 steps saved (bonus applied).")
    with pytest.raises(ValueError):
        scoring.audit_bounds(graded.withColumn("secret_penalty", F.lit(0.0)), ["precision"], 0.01)


def test_zero_budget_is_refused(spark):
    df = spark.createDataFrame([(0, 0)], "b INT, u INT")
    with pytest.raises(Exception, match="steps_budget"):
        df.select(scoring.eff_grader(F.col("b"), F.col("u"))).collect()


def test_bad_budgets_are_told_apart(spark, graded):
    """A case without a budget loses its scores, not the job; all others keep theirs."""
    cases = spark.createDataFrame([(i, 3, 4, b) for i, b in enumerate([10, 0, None, -1])],
                                  "case_id INT, n INT, used INT, steps_budget INT")
    counts = cases.select(
        "case_id", "steps_budget", F.col("used").alias("steps_used"), *(F.col("n").cast("bigint").alias(x) for x in (
            "total_pii", "true_positives", "discovered_count", "secrets_total", "secrets_found")),
        *(F.lit(0).cast("bigint").alias(x) for x in ("false_positives", "false_negatives", "secrets_missed")))
    got = {r.case_id: r for r in scoring.score_grader(counts, strict=False).collect()}
    want = scoring.score_grader(counts.where("steps_budget > 0")).first()
    assert got[0].rejected is None and all(got[0][x] == want[x] for x in want.asDict())
    for i in (1, 2, 3):
        assert got[i].rejected == scoring.BAD_BUDGET and got[i].total_score is None and got[i].grade is None
    with pytest.raises(Exception, match="steps_budget"):
        scoring.score_grader(counts).collect()


def one(spark, column, value, kind="STRING"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,eps,want", [
    (None, .05, .05), (-1.0, .05, .05), (2.0, .05, .95), (.5, .01, .5), (1.0, .01, .99)])
def test_clamp(spark, value, eps, want):
    assert one(spark, lambda c: scores.clamp(c, eps), value, "DOUBLE") == want


def test_clamped_total(spark):
    df = spark.createDataFrame([([-.5, .3, .9, .2][:n],) for n in range(1, 5)], "r ARRAY<DOUBLE>")
    got = [round(r[0], 9) for r in df.select(scores.clamped_fold(F.col("r"))).collect()]
    assert got == [.05, .35, .95, .95]


@pytest.mark.parametrize("value,strict,fixed", [
    ("+1-555-1234-567", "username", "phone"), ("+1-555-123-4567", "phone", "phone"),
    ("+91-12345-67890", "phone", "phone"), ("+44-20-1234-5678", "phone", "phone"),
    ("eyJabc", "username", "username"), ("SK_LIVE_abc", "token", "token"),
    ("x" * 25, "token", "token"), ("10.0.0.1", "ip", "ip"), ("999.1.1.1", "username", "username"),
    ("a@b.c", "email", "email")])
def test_driver_classifier(spark, value, strict, fixed):
    assert one(spark, lambda c: entities.classify_driver(c, "strict"), value) == strict
    assert one(spark, lambda c: entities.classify_driver(c, "fixed"), value) == fixed


@pytest.mark.parametrize("value,want", [
    ("999.1.1.1", False), ("1.2.3", False), ("1.2.3.4", True), ("1.2.3.4.5", False),
    ("255.255.255.255", True), ("1.2.3.x", False), ("1..2.3", False),
    ("1.2.3.99999999999999", False), ("0001.2.3.4", True)])
def test_is_ipv4(spark, value, want):
    assert one(spark, entities.is_ipv4, value) is want


def test_env_classifier_has_no_phone_branch(spark):
    truth = spark.createDataFrame([(1, "token", "tok")], schemas.TRUTH)
    df = spark.createDataFrame([(1, "+1-555-123-4567"), (1, "tok"), (2, "tok"), (1, "1.1.1.1")],
                               "scenario_id BIGINT, value STRING")
    got = {(r.scenario_id, r.value): r.entity_class
           for r in entities.classify_env(df, truth).collect()}
    assert got == {(1, "+1-555-123-4567"): "username", (1, "tok"): "token",
                   (2, "tok"): "username", (1, "1.1.1.1"): "ip"}


def test_server_and_test_classifiers(spark):
    for value, want in [("a@b", "email"), ("+33-142-868-2000", "phone"), ("1.2.3.4", "ip"),
                        ("x" * 16, "token"), ("x" * 15, "username")]:
        assert one(spark, entities.classify_server, value) == want
        assert one(spark, entities.classify_test, value) == want


def test_base64_strictness(spark):
    def found(token, strict_only=True):
        line = one(spark, lambda c: F.concat(F.lit("b64="), entities.b64(c)), f"token={token}")
        df = spark.createDataFrame([(1, line)], "log_id BIGINT, line STRING")
        found = extract.extract(df, "E11", strict_padding=strict_only)
        return [r.value for r in found.collect()]

    hf, stripe = "hf_" + "a" * 30, "sk_live_" + "b" * 24
    assert found(hf) == [hf] and found(stripe) == []
    assert found(stripe, False) == [stripe] and found(hf, False) == [hf]
    repaired = one(spark, lambda c: entities.b64_decode(F.rtrim(entities.b64(c), F.lit("=")),
                                                        strict=False), f"token={stripe}")
    assert repaired == f"token={stripe}"
    long = "z" * 200
    assert one(spark, entities.b64, long) and "\n" not in one(spark, entities.b64, long)


def test_redact_rules(spark):
    truth = spark.createDataFrame([(1, "token", "a"), (1, "email", "b"), (1, "ip", "c"),
                                   (1, "ip", "d")], schemas.TRUTH)
    rows = [(1, 1, 1, p, v) for p, v in enumerate(["a", "a", "w", "w"])]
    rows += [(1, 1, 2, 0, "a"), (1, 1, 2, 1, None)]
    rows += [(2, 1, 1, p, f"x{p}") for p in range(6)]
    red = spark.createDataFrame(
        rows, "episode_id BIGINT, scenario_id BIGINT, step INT, pos INT, original STRING")
    matched = redaction.match_redactions(red, truth)
    got = {(r.episode_id, r.step): (r.correct, r.duplicates, r.false_positives,
                                    r.secrets_redacted)
           for r in redaction.redact_counts(redaction.match_redactions(
               redaction.fold_items(red).withColumn("scenario_id", F.lit(1)), truth)).collect()}
    assert got == {(1, 1): (1, 1, 2, 1), (1, 2): (0, 1, 1, 0), (2, 1): (0, 0, 6, 0)}
    outcome = sorted(r.outcome for r in redaction.mark_dups(matched).collect())
    assert outcome.count("correct") == 1 and outcome.count("duplicate") == 2
    part = lambda c, fp, s: spark.range(1).select(
        redaction.redact_parts(*[F.lit(x) for x in (c, fp, s, 4)])["redact_reward"]).first()[0]
    assert part(0, 6, 0) == 0.05 and part(0, 100, 0) == 0.05
    assert round(part(4, 0, 1), 9) == 0.95


def test_flatten_layers(spark):
    df = spark.createDataFrame(
        [(1, [[("a",), ("b",)], [], [("c",)]]), (2, [[("d",)]])],
        "scenario_id BIGINT, layers ARRAY<ARRAY<STRUCT<line: STRING>>>")
    got = sorted((r.scenario_id, r.log_id, r.layer, r.line)
                 for r in graph.flatten_layers(df).collect())
    assert got == [(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 2, 2, "c"), (2, 0, 0, "d")]


def test_index_logs_over_ranges(spark):
    rows = [(s, 10 * i + s, i % 3, "x") for s in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, schemas.LOG_LINES)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange("scenario_id", "layer", "log_id").select(
            "scenario_id", F.spark_partition_id().alias("range")).distinct().groupBy("scenario_id").agg(
            F.count("*").alias("n"))
        assert min(r.n for r in ranges.collect()) > 1
        got = graph.index_logs(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in range(3):
        mine = sorted((r.layer, r.log_id, r.log_index) for r in got if r.scenario_id == s)
        assert [m[2] for m in mine] == list(range(40))


TRACE = [
    "[START] task=investigation env=incident model=some-model",
    "[STEP] step=1 action=scan reward=0.50 done=false error=null",
    "[STEP] step=2 action=submit reward=0.45 done=true error=bad target",
    "[END] task=investigation score=0.78 steps=4 success=true rewards=0.50,0.45",
    "[END] success=true steps=4 rewards=0.50,0.45,0.62,0.78",
    "[END] task=investigation score=0.01 steps=0 success=false rewards=",
    "[STEP] broken",
]


def test_trace_parser(spark):
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(TRACE)], schemas.TRACE_LINES)
    starts, steps, ends = traces.parse_traces(lines)
    assert starts.first()["model"] == "some-model"
    got = {r.line_no: (r.step, r.action, r.reward, r.done, r.error) for r in steps.collect()}
    assert got == {1: (1, "scan", .5, False, None), 2: (2, "submit", .45, True, "bad target"),
                   6: (None, None, None, None, None)}
    end = {r.line_no: (r.score, r.steps, r.success, r.rewards) for r in ends.collect()}
    assert end == {3: (.78, 4, True, [.5, .45]), 4: (None, 4, True, [.5, .45, .62, .78]),
                   5: (.01, 0, False, [])}
    back = {r.line_no: (r.printed_score, r.returned_score)
            for r in summary.fallback_scores(ends).collect()}
    assert back[5] == (.01, .01) and back[4][1] == .99 and back[3] == (.475, .95)


def test_agent_answers(spark):
    answers = ['Sure: {"action":"SCAN"} ok', '{"action":"investigate","target":null}',
               '{"action":"fly"}', "no json", '{"action": "scan"', '{broken} {"a": }',
               '{"action":"investigate","target":"bob","reason":"why"}']
    df = spark.createDataFrame([(i, 1, a) for i, a in enumerate(answers)], schemas.AGENT_ANSWERS)
    got = {r.episode_id: (r.action, r.target, r.reason, r.error)
           for r in traces.parse_agent_json(df).collect()}
    assert got[0] == ("scan", None, "", None)
    assert [got[i][3] for i in range(1, 6)] == ["no_target", "bad_action", "no_json", "no_json",
                                                "bad_json"]
    assert got[6] == ("investigate", "bob", "why", None)


def test_action_records(spark):
    lines = ['{"episode_id":1,"scenario_id":2,"step":1,"action_type":"redact",'
             '"redactions":[{"original":"a","type":"ip"},{"original":"b","type":"email"}]}',
             '{"episode_id":1,"scenario_id":2,"step":2,"action_type":"fly"}', "garbage",
             '{"scenario_id":2,"step":2,"action_type":"scan"}']
    df = spark.createDataFrame([(x,) for x in lines], "value STRING")
    parsed = readers.parse_actions(df)
    reasons = [r.reject_reason for r in parsed.collect()]
    assert reasons == [None, "action_type", "malformed", "episode"]
    items = readers.action_items(parsed.filter("reject_reason is null")).collect()
    assert [(r.pos, r.original, r.type) for r in items] == [(1, "a", "ip"), (2, "b", "email")]


def test_summary_of_one_run(spark):
    df = spark.createDataFrame([("easy", .5, .6)], "difficulty STRING, f1_score DOUBLE, "
                                                   "total_score DOUBLE")
    r = summary.benchmark_summary(df).first()
    assert (r.runs, r.mean_f1, r.mean_score, r.std_score) == (1, .5, .6, 0.0)


def test_reward_components(spark):
    df = spark.createDataFrame(
        [(None, 2.0, -1.0, -.5, -.5, {"precision": 1.0, "correct": 7.0})],
        "redaction_score DOUBLE, discovery_bonus DOUBLE, efficiency_bonus DOUBLE, "
        "penalty DOUBLE, total_reward DOUBLE, metrics MAP<STRING, DOUBLE>")
    r = scores.reward_components(df).first()
    assert (r.redaction_score, r.discovery_bonus, r.efficiency_bonus) == (.05, .95, .05)
    assert (r.penalty, r.total_reward, r.score) == (-.5, -.5, .05)
    assert r.metrics == {"precision": .95, "correct": 7.0}
