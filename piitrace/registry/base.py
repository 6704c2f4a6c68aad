"""Query registry: a Spark callable and, where SQL can say it, its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piitrace.plans.replay import Replay
from piitrace.registry import oracle
from piitrace.sources.incident import Incident

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_incidents: dict[tuple[str, str], Incident] = {}
_replays: dict[tuple[str, str], Replay] = {}


def add(name: str, build: Query, body: str | None = None, **extra: str) -> None:
    """Register ``build(spark, folder)``; ``body`` is SQL over the oracle's tables."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = build
    if body is not None:
        ORACLES[name] = oracle.sql(body, **extra)


def on_incident(name: str, build: Callable[[Incident], DataFrame], body: str | None = None,
                **extra: str) -> None:
    add(name, lambda spark, folder: build(incident(spark, folder)), body, **extra)


def on_replay(name: str, build: Callable[[Replay], DataFrame], body: str | None = None,
              **extra: str) -> None:
    add(name, lambda spark, folder: build(replay(spark, folder)), body, **extra)


def forget() -> None:
    """Drop the tables kept per session and folder, so that the next query builds them."""
    _incidents.clear()
    _replays.clear()


def incident(spark: SparkSession, folder: str) -> Incident:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _incidents:
        _incidents[key] = Incident.load(spark, folder)
    return _incidents[key]


def replay(spark: SparkSession, folder: str) -> Replay:
    """Its tables are built with it; a query that takes the incident alone builds those it reads."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _replays:
        _replays[key] = Replay.of(incident(spark, folder))
    return _replays[key]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """All texts: log lines, documents, pages and conversation turns."""
    part = lambda df, src, key, text: df.select(
        F.lit(src).alias("src"), key.cast("bigint").alias("id"), F.col(text).alias("text")
    )
    c = F.col
    return (
        part(incident(spark, folder).logs, "log", c("log_id"), "line")
        .unionByName(part(table(spark, folder, "documents"), "document", c("doc_id"), "text"))
        .unionByName(part(table(spark, folder, "pages"), "page", c("page_id"), "html"))
        .unionByName(part(table(spark, folder, "conversations"), "turn",
                          c("conv_id") * 100000 + c("turn"), "text"))
    )
