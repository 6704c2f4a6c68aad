"""Readers and writers for logs, recorded actions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from piitrace import schemas

LOG_FORMATS = ("text", "json", "parquet")


def read_logs(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Log lines from files. ``text`` gives the line only; ``json`` and ``parquet``
    follow the declared log schema. No schema is inferred."""
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", "line")
    if fmt in ("json", "parquet"):
        return spark.read.format(fmt).schema(schemas.LOG_LINES).load(path)
    raise ValueError(f"fmt must be one of {LOG_FORMATS}, not {fmt!r}")


def parse_actions(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON action records with a ``reject_reason``; null means accepted.

    Reasons: ``malformed`` (not a record of the schema), ``action_type`` (outside
    the four known ones), ``episode`` (no episode, scenario or step).
    """
    corrupt = StructField("_corrupt", StringType())
    schema = StructType([*schemas.ACTION_RECORD.fields, corrupt])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.select(
        F.col(col).alias("raw"), F.from_json(F.col(col), schema, options).alias("a")
    ).select("raw", "a.*")
    n = F.col
    reason = (
        F.when(n("_corrupt").isNotNull(), "malformed")
        .when(~F.coalesce(n("action_type").isin(*schemas.ACTION_TYPES), F.lit(False)),
              "action_type")
        .when(n("episode_id").isNull() | n("scenario_id").isNull() | n("step").isNull(),
              "episode")
    )
    return parsed.withColumn("reject_reason", reason).drop("_corrupt")


def read_actions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted actions, their redaction items, and rejects, from JSON lines."""
    parsed = parse_actions(spark.read.text(path))
    good = parsed.filter("reject_reason is null")
    actions = good.select("episode_id", "scenario_id", "strategy", "step", "action_type",
                          "target_entity")
    rejects = parsed.filter("reject_reason is not null").select("raw", "reject_reason")
    return actions, action_items(good), rejects


def action_items(records: DataFrame) -> DataFrame:
    """Redaction items of action records, one row each, numbered in list order."""
    return records.select(
        "episode_id", "step", F.posexplode("redactions").alias("pos", "item")
    ).select("episode_id", "step", (F.col("pos") + 1).alias("pos"), "item.original", "item.type")


def write_actions(actions: DataFrame, path: str) -> None:
    """Actions without item lists as JSON lines."""
    actions.select("episode_id", "scenario_id", "strategy", "step", "action_type",
                   "target_entity").write.json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Scores as parquet, one folder per difficulty."""
    scores.write.partitionBy("difficulty").parquet(path)
