"""Drained streams against batch results, and online scoring out of order."""

import datetime as dt

from pyspark.sql import functions as F

from piitrace import schemas
from piitrace.operators import extract
from piitrace.session import scratch
from piitrace.sources.incident import Incident
from piitrace.streaming import online, sinks, streams, timed
from piitrace.streaming.sightings import first_sightings
from tests.scenes import frames, make


def rows(df):
    return sorted(tuple(str(c) for c in r) for r in df.collect())


def test_mask_stream_equals_batch(spark, folder):
    lines = streams.line_stream(streams.event_stream(spark, folder))
    out = streams.drain(streams.stream_mask(lines).select("log_id", "masked"), "t-mask")
    batch = extract.mask_text(Incident.load(spark, folder).logs).select("log_id", "masked")
    assert rows(out) == rows(batch)


def test_first_seen_stream(spark, folder):
    lines = streams.line_stream(streams.event_stream(spark, folder))
    out = streams.drain(streams.stream_first_seen(lines, "60 days"), "t-first")
    batch = extract.extract_pii(Incident.load(spark, folder).logs)
    key = ["scenario_id", "value"]
    assert rows(out.select(*key)) == rows(batch.select(*key))


def test_closed_windows_equal_batch(spark, folder):
    lines = streams.line_stream(streams.event_stream(spark, folder))
    out = streams.drain(streams.stream_pii_counts(lines), "t-counts")
    static = streams.line_stream(spark.read.parquet(f"{folder}/events.parquet"))
    hits = extract.all_matches(static, "line", ("log_id", "ts"))
    batch = hits.groupBy(F.window("ts", "1 day").alias("w"), "pii_type").agg(
        F.count(F.lit(1)).alias("hits")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             "pii_type", "hits")
    last = out.agg(F.max("window_end")).first()[0]
    assert rows(out) == rows(batch.filter(F.col("window_end") <= F.lit(last)))
    assert out.count() > 50


def test_online_scores_with_late_steps(spark):
    """Actions in two files, later steps first: results as if they came in order."""
    tables, plays = make(8, scenarios=4, per=3)
    f = frames(spark, tables)
    lists = {}
    for e, step, _, value, kind in tables["redactions"]:
        lists.setdefault((e, step), []).append((value, kind))
    records = [(*a, lists.get((a[0], a[3]))) for a in tables["actions"]]
    path = scratch(spark, "t-actions")
    for part in ([r for r in records if r[3] % 2 == 0], [r for r in records if r[3] % 2]):
        spark.createDataFrame(part, schemas.ACTION_RECORD).coalesce(1).write.mode("append").json(
            path)
    stream = spark.readStream.schema(schemas.ACTION_RECORD).option("maxFilesPerTrigger", 1).json(
        path)
    scored = online.drain_scores(
        online.stream_score(
            stream, online.effects(f["logs"], f["edges"], f["truth"], f["honeypots"]),
            online.scenario_facts(f["scenarios"], f["logs"], f["truth"])),
        "t-scores")
    got = {}
    for r in scored.orderBy("episode_id", "step").collect():
        got.setdefault(r.episode_id, []).append(
            (r.step, r.reward, r.cumulative_reward, r.visible_total, r.discovered_total,
             r.redacted_total))
    assert got == {e: steps for e, steps in plays.items() if steps}


BASE = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def at(**span):
    return BASE + dt.timedelta(**span)


def files(spark, batches, schema):
    """One file a micro-batch, in order."""
    path = scratch(spark, "t-files")
    for rows_of in batches:
        spark.createDataFrame(rows_of, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_sightings_out_of_order(spark):
    """Later batches bring earlier lines and an earlier pattern for the same value."""
    schema = "scenario_id BIGINT, log_id BIGINT, line STRING, ts TIMESTAMP"
    batches = [
        [(1, 50, "10.0.0.1 and a@b.co", at(hours=5)), (1, 51, "auth=abcdefghijkl", at(hours=6))],
        [(1, 40, "user=ann wrote a@b.co", at(hours=4)), (1, 41, "token=abcdefghijkl a@b.co", at(hours=4)),
         (2, 60, "mail a@b.co", at(hours=7))],
        [(1, 70, "a@b.co again", at(hours=12)), (9, 1, "no value", at(days=3))],
        [(1, 80, "a@b.co after its time", at(days=3, hours=2)), (9, 2, "no value", at(days=9))],
        [(9, 3, "no value", at(days=12))],
    ]
    out = streams.drain_stateful(first_sightings(files(spark, batches, schema), "6 hours", keep_ms=86_400_000),
                                 "t-sightings")
    got = sorted((r.scenario_id, r.value, r.log_id, r.pattern_id) for r in out.collect())
    assert got == [
        (1, "10.0.0.1", 50, "E2"), (1, "a@b.co", 40, "E1"), (1, "a@b.co", 80, "E1"),
        (1, "abcdefghijkl", 41, "E20"), (1, "ann", 40, "E4"), (2, "a@b.co", 60, "E1")]


def recorded(spark, n_scenarios=3):
    tables, plays = make(8, scenarios=n_scenarios, per=3)
    lists = {}
    for e, step, _, value, kind in tables["redactions"]:
        lists.setdefault((e, step), []).append((value, kind))
    f = frames(spark, tables)
    parts = (online.effects(f["logs"], f["edges"], f["truth"], f["honeypots"]),
             online.scenario_facts(f["scenarios"], f["logs"], f["truth"]))
    return [(*a, lists.get((a[0], a[3]))) for a in tables["actions"]], plays, parts


TIMED = "episode_id BIGINT, scenario_id BIGINT, strategy INT, step INT, action_type STRING, target_entity STRING, " \
    "redactions ARRAY<STRUCT<original: STRING, type: STRING>>, received_at TIMESTAMP"


def beat(when):
    return (None, None, None, None, None, None, None, when)


def test_gap_late_action_and_expiry(spark):
    """Step 2 of an episode is lost; the others score on, it comes too late, the episode ends by itself."""
    records, plays, parts = recorded(spark)
    episode = max(plays, key=lambda e: len(plays[e]))
    live = len(plays[episode])
    assert live >= 4
    sent = [(*r, at(minutes=r[3])) for r in records if r[0] == episode and r[3] != 2 and r[3] < live]
    late = [(*r, at(hours=30)) for r in records if r[0] == episode and r[3] == 2]
    other = [(*r, at(minutes=r[3])) for r in records if r[0] != episode]
    batches = [sent + other, [beat(at(hours=24))], late + [beat(at(hours=30))], [beat(at(days=9))], [beat(at(days=9))]]
    scored = timed.stream_score_timed(files(spark, batches, TIMED), *parts, wait_ms=3_600_000, idle_ms=3 * 86_400_000)
    got = streams.drain_stateful(scored, "t-timed").collect()
    mine = [(r.step, r.status) for r in got if r.episode_id == episode]
    assert sorted(mine) == sorted([(1, "applied"), (2, "missing"), (2, "late"), (live - 1, "expired"),
                                   *((s, "applied") for s in range(3, live))])
    totals = {}
    for r in got:
        if r.episode_id != episode and r.status == "applied":
            totals.setdefault(r.episode_id, []).append((r.step, r.reward, r.cumulative_reward, r.visible_total,
                                                        r.discovered_total, r.redacted_total))
    assert {e: sorted(x) for e, x in totals.items()} == {
        e: steps for e, steps in plays.items() if steps and e != episode}


def test_restart_keeps_the_state(spark):
    """The stream stops with steps waiting and is started again: the missing step is applied, not lost."""
    records, plays, parts = recorded(spark)
    episode = max(plays, key=lambda e: len(plays[e]))
    mine = [(*r, at(minutes=r[3])) for r in records if r[0] == episode]
    path, out = scratch(spark, "t-restart"), scratch(spark, "t-restart-out")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STATE_STORE)
    try:
        for part in ([r for r in mine if r[3] != 2], [r for r in mine if r[3] == 2]):
            spark.createDataFrame(part, TIMED).coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema(TIMED).parquet(path)
            timed.stream_score_timed(stream, *parts, wait_ms=3_600_000, idle_ms=86_400_000).writeStream.format(
                "parquet").option("path", out).option("checkpointLocation", out + "-progress").trigger(
                availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out).orderBy("step").collect()
    assert [(r.step, r.reward, r.cumulative_reward, r.visible_total, r.discovered_total, r.redacted_total)
            for r in got] == plays[episode] and {r.status for r in got} == {"applied"}


def test_a_replayed_batch_changes_nothing(spark):
    """Counts after a batch was handed over twice, once before its ledger row was written; late rows apart."""
    path = scratch(spark, "t-ledger")
    write = sinks.counting_sink(path, "1 day", "6 hours")
    batch = lambda *rows_of: spark.createDataFrame(list(rows_of), "pii_type STRING, ts TIMESTAMP")
    first = batch(("email", at(hours=3)), ("email", at(hours=4)), ("ip", at(days=2, hours=1)))
    second = batch(("email", at(hours=5)), ("ip", at(days=1, hours=20)), ("ip", at(days=2, hours=2)))
    assert sinks.counts(spark, path).count() == 0
    write(first, 0)
    once = rows(sinks.counts(spark, path))
    write(first, 0)
    assert rows(sinks.counts(spark, path)) == once
    write(second, 1)
    both = rows(sinks.counts(spark, path))
    write(second, 1)
    write(first, 0)
    assert rows(sinks.counts(spark, path)) == both
    got = {(r.window_start.day, r.pii_type): (r.hits, r.late) for r in sinks.counts(spark, path).collect()}
    # The first day had closed six hours behind the latest line of the first batch; the second had not.
    assert got == {(1, "email"): (2, 1), (3, "ip"): (2, 0), (2, "ip"): (1, 0)}


def test_counts_go_on_after_a_restart(spark, folder):
    lines = lambda: streams.line_stream(streams.event_stream(spark, folder))
    path = scratch(spark, "t-counted")
    first = rows(sinks.drain_counts(streams.stream_matches(lines()), path))
    assert len(first) > 50 and rows(sinks.drain_counts(streams.stream_matches(lines()), path)) == first
