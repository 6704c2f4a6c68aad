"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from piitrace.registry import (  # noqa: F401
    q_extract,
    q_graph,
    q_replay,
    q_scalar,
    q_score,
    q_snapshots,
    q_stream,
    q_synth,
)
from piitrace.registry.base import ORACLES, QUERIES, replay

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """One scored row per recorded episode."""
    return replay(spark, folder).episode_scores.select(
        "episode_id", "difficulty", "strategy", "step", "submit_score", "f1_score",
        "discovery_rate", "cumulative_reward", "grade",
    )
