"""Session helpers shared by the iterative plans and the stream drains."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_recorders: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A cluster has to name one. Only a ``local`` master, where driver and
    executors are one machine, may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="piitrace-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to a table in the shared folder and go on from that table.

    Used between rounds of an iterative plan, and for a table several branches of
    one plan read. The files survive the loss of any executor, and readers get
    column pruning and true sizes.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    for made in _recorders:
        made.append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once whatever was made of them has been written itself.

    Nothing that is still to be computed may read them. Other DataFrames are left alone.
    """
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            table._scratch = None


def tidy(spark: SparkSession) -> None:
    """Let the driver notice which finished shuffles nothing refers to any more, so that their files go."""
    spark._jvm.System.gc()


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that ``cut`` writes inside the block."""
    made: list[DataFrame] = []
    _recorders.append(made)
    try:
        yield made
    finally:
        _recorders.remove(made)


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/piitrace-{label}-{uuid.uuid4().hex}"
