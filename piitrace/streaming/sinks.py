"""Window counts that a replayed batch does not change, with late rows counted.

A stream may hand a batch over again after a failure. What a batch adds is written to a folder
named by its id, which a second writing replaces; a ledger row, written after it, makes it count. The
counts are the sums over the batches in the ledger.

The ledger also keeps the latest event time up to each batch. A row is late if its window had closed,
``delay`` behind that time, before its batch began: late rows are counted per window and type beside the others.
The earlier ledger rows decide, so a replay decides alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "batch BIGINT, latest TIMESTAMP"
COUNTS = "window_start TIMESTAMP, window_end TIMESTAMP, pii_type STRING, hits BIGINT, late BIGINT, batch BIGINT"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The batches that count: (batch, latest)."""
    return _table(spark, f"{path}/ledger", LEDGER)


def counting_sink(path: str, window: str = "1 day", delay: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` on a stream of matches (pii_type, ts): adds each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = ledger(spark, path).where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        closed = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col("w.end") <= closed, F.lit(False))
        rows = batch.select(F.window("ts", window).alias("w"), "pii_type").withColumn("is_late", late)
        rows.groupBy("w", "pii_type").agg(
            F.count(F.when(~F.col("is_late"), 1)).alias("hits"), F.count(F.when(F.col("is_late"), 1)).alias("late"),
        ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "pii_type", "hits",
                 "late").write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")
        batch.agg(F.greatest(F.max("ts"), F.lit(before).cast("timestamp")).alias("latest")).write.mode(
            "overwrite").parquet(f"{path}/ledger/batch={batch_id}")

    return write


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(window_start, window_end, pii_type, hits, late) over all batches of the ledger."""
    rows = _table(spark, f"{path}/counts", COUNTS).join(ledger(spark, path).select("batch"), "batch", "left_semi")
    return rows.groupBy("window_start", "window_end", "pii_type").agg(
        F.sum("hits").alias("hits"), F.sum("late").alias("late"))


def drain_counts(matches: DataFrame, path: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Count all that a stream of matches has available and read the counts."""
    matches.writeStream.foreachBatch(counting_sink(path, window, delay)).option(
        "checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return counts(matches.sparkSession, path)
