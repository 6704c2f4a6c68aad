"""Streaming extraction, counts, alerts and online scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piitrace.operators import extract
from piitrace.session import scratch
from piitrace.sources.incident import log_lines

EVENT_SCHEMA = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING"
)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events file of a folder as a stream."""
    return (
        spark.readStream.schema(EVENT_SCHEMA)
        .option("pathGlobFilter", "events.parquet").parquet(folder)
    )


def line_stream(events: DataFrame) -> DataFrame:
    """Log lines of an event stream with an event-time column of type TIMESTAMP."""
    return log_lines(events).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data now available into a parquet table and read it back."""
    spark = stream.sparkSession
    path = scratch(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", f"{path}-progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


#: Keeps the state of keyed processors on disk.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A batch stores what it has changed, not every file of every store.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def drain_stateful(stream: DataFrame, label: str) -> DataFrame:
    """``drain`` for keyed state and timers, with the state store they need."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        conf.set(name, value)
    try:
        return drain(stream, label)
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)


def stream_mask(lines: DataFrame, profile: str = "demo") -> DataFrame:
    """Stateless masking: the batch projection on a stream."""
    return extract.mask_text(lines, "line", profile)


def stream_matches(lines: DataFrame, profile: str = "demo") -> DataFrame:
    """Stateless extraction: the batch projection on a stream."""
    return extract.all_matches(lines, "line", ("scenario_id", "log_id", "ts"), profile)


def stream_first_seen(lines: DataFrame, delay: str = "1 day", profile: str = "demo") -> DataFrame:
    """First sighting per (scenario, value) within the watermark.

    Pattern precedence inside a line is settled in the row, before the state.
    """
    m = extract.line_matches(lines, "line", ("scenario_id", "log_id", "ts"), profile)
    return (
        m.select("scenario_id", "value", "pii_type", "log_id", "ts")
        .withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["scenario_id", "value"])
    )


def stream_pii_counts(lines: DataFrame, window: str = "1 day", slide: str | None = None,
                      session_gap: str | None = None, delay: str = "1 hour",
                      profile: str = "demo") -> DataFrame:
    """Hits per type in tumbling, sliding or session windows; late rows are dropped."""
    m = stream_matches(lines, profile).withWatermark("ts", delay)
    span = F.session_window("ts", session_gap) if session_gap else F.window("ts", window, slide)
    return m.groupBy(span.alias("w"), "pii_type").agg(F.count(F.lit(1)).alias("hits")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "pii_type",
        "hits",
    )


def stream_honeypot(actions: DataFrame, honeypots: DataFrame) -> DataFrame:
    """Alerts: investigations of a honeypot, as they arrive."""
    traps = honeypots.select("scenario_id", F.col("value").alias("target_entity"))
    return actions.filter("action_type = 'investigate'").join(
        traps, ["scenario_id", "target_entity"], "left_semi"
    )
