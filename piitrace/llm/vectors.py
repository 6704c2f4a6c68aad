"""Vectors of a table as bytes, with the rows that can be compared told apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``row`` (a number of its own for every row), ``key`` and ``vec``: the components as 64-bit
    floats, or null if the vector is null, empty, zero or has a null or non-finite component."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lists = pa.concat_arrays([lists]) if lists.offset else lists
            flat = pc.cast(lists.flatten(), pa.float64())
            values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            ends = np.cumsum(size)
            out = []
            for begin, end in zip((ends - size).tolist(), ends.tolist(), strict=True):
                v = values[begin:end]
                good = len(v) and np.isfinite(v).all() and v.any()
                out.append(np.ascontiguousarray(v, "<f8").tobytes() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())],
                names=["row", "key", "vec"])

    chosen = df.select(F.monotonically_increasing_id().alias("row"), df[key].alias("key"),
                       df[vector].alias("vec"))
    return chosen.mapInArrow(run, f"row long, key {kind}, vec binary")


def matrix(blobs: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    blobs = pa.concat_arrays([blobs]) if blobs.offset else blobs
    bounds = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1)
    data = np.frombuffer(blobs.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    return data.view("<f8").reshape(len(blobs), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps squares finite."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
