"""Numbering rows within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piitrace.session import cut


def number_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``df`` with the 1-based place of each row among those of its keys in column ``name``.

    Rows are dealt by ranges of (keys, order), numbered inside their range and shifted by
    the sizes of the ranges before it. A key with a third of all rows spreads over many
    ranges, whatever its order values look like; one row per key and range is ordered in
    one place.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    # Written once: the sizes and the rows have to come from the same ranges.
    ranged = cut(ranged, "ranges")
    group = [*keys, "_range"]
    sizes = ranged.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        ranged.withColumn("_rn", inside).join(shift, group)
        .withColumn(name, (F.col("_shift") + F.col("_rn")).cast("bigint"))
        .drop("_range", "_rn", "_shift")
    )
