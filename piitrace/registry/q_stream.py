"""Streaming queries (X): drained to a table and read back."""

from pyspark.sql import functions as F

from piitrace import schemas
from piitrace.functions.patterns import PROFILES
from piitrace.plans.replay import number_steps
from piitrace.registry.base import add, incident
from piitrace.registry.oracle import hits
from piitrace.registry.q_extract import _mask_sql
from piitrace.session import cut, scratch
from piitrace.streaming import online, sinks, streams, timed
from piitrace.streaming.sightings import first_sightings

c = F.col


def _lines(spark, folder):
    return streams.line_stream(streams.event_stream(spark, folder))


def _mask(spark, folder):
    out = streams.stream_mask(_lines(spark, folder)).select("log_id", "masked")
    return streams.drain(out, "mask")


add("x1_stream_mask", _mask, f"SELECT log_id, {_mask_sql('line', 'demo')} AS masked FROM logs")


def _first_seen(spark, folder):
    out = streams.stream_first_seen(_lines(spark, folder), "60 days")
    return streams.drain(out, "first-seen").select("scenario_id", "value")


add("x2_stream_first_seen", _first_seen, "SELECT scenario_id, value FROM demo_found")


def _first_sightings(spark, folder):
    """Of values first seen before the last day, which later lines have closed."""
    out = streams.drain_stateful(first_sightings(_lines(spark, folder), "1 day", keep_ms=1 << 40), "sightings")
    return out.select("scenario_id", "value", "log_id", "pattern_id", "pii_type")


add("x2_stream_first_sightings", _first_sightings,
    """SELECT scenario_id, value, log_id, pattern_id, pii_type FROM (SELECT *, row_number() OVER (
        PARTITION BY scenario_id, value ORDER BY ts, log_id, pattern_ord, match_ord) AS rn FROM timed_hits)
      WHERE rn = 1 AND ts < (SELECT max(ts) - INTERVAL 1 DAY FROM lines)""",
    timed_hits=" UNION ALL ".join(hits(p, i, "lines", "scenario_id, log_id, ts", "line", "demo")
                                  for i, p in enumerate(PROFILES["demo"])))

_STREAM_HITS = " UNION ALL ".join(
    hits(p, i, "lines", "log_id, ts", "line", "demo") for i, p in enumerate(PROFILES["demo"]))
_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM stream_hits)"


def _stamps(df):
    text = lambda col: F.date_format(col, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns({"window_start": text("window_start"), "window_end": text("window_end")})


def _counts(label, **window):
    def build(spark, folder):
        out = streams.stream_pii_counts(_lines(spark, folder), **window)
        return _stamps(streams.drain(out, label))

    return build


def _window_sql(start, length):
    fmt = "'%Y-%m-%d %H:%M:%S'"
    return f"""SELECT strftime(w, {fmt}) AS window_start,
      strftime(w + INTERVAL {length}, {fmt}) AS window_end, pii_type, count(*) AS hits
      FROM ({start}) WHERE w + INTERVAL {length} <= {_CLOSED} GROUP BY ALL"""


add("x3_stream_counts_tumbling", _counts("tumbling", window="1 day"),
    _window_sql("SELECT date_trunc('day', ts) AS w, pii_type FROM stream_hits", "1 DAY"),
    stream_hits=_STREAM_HITS)
add("x3_stream_counts_sliding", _counts("sliding", window="1 day", slide="12 hours"),
    _window_sql("""SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01')
      - k * INTERVAL 12 HOUR AS w, pii_type FROM stream_hits, (VALUES (0), (1)) AS t(k)""",
                "1 DAY"),
    stream_hits=_STREAM_HITS)


def _counted_once(spark, folder):
    """All windows, also those still open, from a ledger of batches."""
    matches = streams.stream_matches(_lines(spark, folder))
    return _stamps(sinks.drain_counts(matches, scratch(spark, "counted")))


add("x3_stream_counts_once", _counted_once,
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
      strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, pii_type,
      count(*) AS hits, 0 AS late FROM stream_hits GROUP BY ALL""",
    stream_hits=_STREAM_HITS)
add("x3_stream_counts_session", _counts("session", session_gap="2 hours"),
    f"""SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS window_start,
      strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, pii_type,
      count(*) AS hits FROM (SELECT ts, pii_type, sum(opens) OVER (PARTITION BY pii_type
        ORDER BY ts) AS session FROM (SELECT ts, pii_type, CASE WHEN ts - lag(ts) OVER (
          PARTITION BY pii_type ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens
        FROM stream_hits)) GROUP BY pii_type, session
      HAVING max(ts) + INTERVAL 2 HOUR <= {_CLOSED}""",
    stream_hits=_STREAM_HITS)


def _action_rows(spark, folder, numbered=False):
    """Recorded actions as records. A record holds its own action's items, a list the derived
    episodes keep below 40. Online scoring needs steps that count from 1 without gaps."""
    i = incident(spark, folder)
    lists = i.redactions.groupBy("episode_id", "step").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "original", "type"))),
            lambda r: F.struct(r["original"].alias("original"), r["type"].alias("type")),
        ).alias("redactions"))
    keep = (c("action_type") == "redact")
    rows = i.actions.join(
        lists.withColumn("_r", F.lit(True)), ["episode_id", "step"], "left"
    ).withColumn("redactions", F.when(keep, c("redactions"))).drop("_r")
    if numbered:
        rows = number_steps(rows).withColumn("step", c("step_no").cast("int")).drop("step_no")
    return rows


def _action_files(spark, folder, numbered=False):
    """The same as a folder of JSON files."""
    path = scratch(spark, "action-files")
    _action_rows(spark, folder, numbered).write.json(path)
    return spark.readStream.schema(schemas.ACTION_RECORD).json(path)


def _honeypot(spark, folder):
    i = incident(spark, folder)
    alerts = streams.stream_honeypot(_action_files(spark, folder), i.honeypots)
    return streams.drain(alerts.select("episode_id", "step", "target_entity"), "alerts")


add("x5_stream_honeypot", _honeypot,
    """SELECT episode_id, step, target_entity FROM actions a WHERE action_type = 'investigate'
      AND EXISTS (SELECT 1 FROM honeypots h WHERE h.scenario_id = a.scenario_id
        AND h.value = a.target_entity)""")


def _static(i):
    """What every batch joins, written once."""
    return (cut(online.effects(i.labels, i.edges, i.truth, i.honeypots), "effects"),
            cut(online.scenario_facts(i.scenarios, i.labels, i.truth), "facts"))


def _score(spark, folder):
    brings, facts = _static(incident(spark, folder))
    return online.drain_scores(
        online.stream_score(_action_files(spark, folder, numbered=True), brings, facts), "scores")


add("x4_stream_score", _score,
    """SELECT episode_id, step, action_type, reward, cumulative_reward, visible_total,
      discovered_total, redacted_total, terminated, truncated FROM totalled""")


#: Hours at which the batches of the timed stream arrive: actions, a heartbeat, lost actions, heartbeats.
_HOURS = (0, 24, 30, 216, 217)


def _timed(spark, folder):
    """Some actions get lost and arrive a day after the others; episodes that stay open run out."""
    i = incident(spark, folder)
    rows = _action_rows(spark, folder, numbered=True)
    # Written once: two parts read it, each in one task, since a file is a batch.
    rows = cut(rows.select(*schemas.ACTION_RECORD.names), "records")
    lost = (c("episode_id") * 7 + c("step")) % 11 == 0
    start = F.lit("2024-03-01 00:00:00").cast("timestamp")
    after = lambda hours, minutes: start + F.make_interval(
        hours=F.lit(hours), mins=minutes)
    beat = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ACTION_RECORD))
    parts = [rows.where(~lost), beat, rows.where(lost), beat, beat]
    path = scratch(spark, "timed-actions")
    for part, hours in zip(parts, _HOURS, strict=True):
        minutes = F.coalesce("step", F.lit(0))
        part.withColumn("received_at", after(hours, minutes)).coalesce(1).write.mode("append").parquet(path)
    schema = rows.withColumn("received_at", start).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    brings, facts = _static(i)
    hour = 3_600_000
    scored = timed.stream_score_timed(stream, brings, facts, hour, 72 * hour, "1 hour")
    return streams.drain_stateful(scored, "timed").select("episode_id", "step", "status")


add("x4_stream_score_timed", _timed,
    """SELECT episode_id, step, status FROM (
      SELECT episode_id, step, CASE WHEN NOT lost THEN 'applied' ELSE 'missing' END AS status FROM sent
        WHERE step < m OR step = m AND NOT lost
      UNION ALL SELECT episode_id, step, 'late' FROM sent WHERE lost AND step < m AND done IS NULL
      UNION ALL SELECT episode_id, step, 'applied' FROM tail WHERE step <= coalesce(done_t, step)
      UNION ALL SELECT s.episode_id, max(s.step), 'expired' FROM sent s LEFT JOIN (
          SELECT DISTINCT episode_id, done_t FROM tail) t ON t.episode_id = s.episode_id
        WHERE done IS NULL AND done_t IS NULL GROUP BY ALL)""",
    allowed="""SELECT n.episode_id, CAST(n.step_no AS INT) AS step, n.action_type = 'submit' OR n.step_no >= s.budget
        AS ends_it, (n.episode_id * 7 + n.step_no) % 11 = 0 AS lost
      FROM numbered n JOIN scenarios s USING (scenario_id) WHERE n.step_no <= s.budget""",
    sent="""SELECT *, coalesce(done, max(CASE WHEN NOT lost THEN step END) OVER (PARTITION BY episode_id), 0) AS m
      FROM (SELECT *, min(CASE WHEN ends_it AND NOT lost THEN step END) OVER (PARTITION BY episode_id) AS done
        FROM allowed)""",
    tail="""SELECT *, min(CASE WHEN ends_it THEN step END) OVER (PARTITION BY episode_id) AS done_t
      FROM sent WHERE done IS NULL AND step > m""")
