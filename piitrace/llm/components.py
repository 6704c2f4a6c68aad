"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piitrace.session import cut, drop


#: Edges of a task.
EDGES = 100_000


def _stars(edges: DataFrame, both: bool, parts: int, salts: int) -> DataFrame:
    """Hang each node's neighbours on its smallest one: the larger neighbours if ``both``
    directions are looked at, else the smaller ones and the node itself.

    The neighbours of a node lie in ``salts`` parts, so a hub is no single task's.
    """
    c = F.col
    if both:
        around = edges.select("a", "b").union(edges.select("b", "a"))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
    around = around.withColumn("salt", salt).repartition(parts, "a", "salt")
    least = around.groupBy(c("a").alias("node"), "salt").agg(F.min("b").alias("low"))
    if salts > 1:
        least = least.groupBy("node").agg(F.min("low").alias("low")).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(parts, "node", "salt")
    least = least.withColumn("low", F.least("low", "node")).select("node", c("salt").alias("of"), "low")
    joined = around.join(least, (c("a") == c("node")) & (c("salt") == c("of")))
    if both:
        out = joined.where("b > a").select(c("b").alias("a"), c("low").alias("b"))
    else:
        out = joined.select(c("b").alias("a"), c("low").alias("b")).union(
            least.where("of = 0").select(c("node").alias("a"), c("low").alias("b")))
    return out.where("a <> b").repartition(parts, "a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, for all ids of the edges (a, b).

    Alternates the two star operations until every node hangs on its component's
    smallest; the number of rounds grows with the logarithm of the nodes. Only row counts
    and one flag pass the driver. Edges with a null end or between equal ids are no links.
    """
    c = F.col
    now = cut(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(),
              "edges")
    while True:
        # As many tasks as the edges fill, and as many for a hub as its neighbours fill.
        size = now.agg(F.count("*").alias("n")).first().n
        if not size:
            break
        parts = 1 + 2 * size // EDGES
        hub = 0 if parts < 2 else now.select("a").union(now.select("b")).groupBy("a").count().agg(
            F.max("count").alias("n")).first().n
        salts = min(64, 1 + hub // EDGES)
        before, now = now, cut(_stars(_stars(now, True, parts, salts), False, parts, salts), "edges")
        drop(before)
        # Done when no node hangs on two others and no centre hangs on another.
        least = now.repartition(parts, "a").groupBy("a").agg(F.count("*").alias("n"))
        centres = now.select(c("b").alias("a")).repartition(parts, "a").distinct()
        if least.where("n > 1").isEmpty() and least.join(centres, "a", "left_semi").isEmpty():
            break
    return now.select(c("a").alias("id"), c("b").alias("component")).union(
        now.select(c("b").alias("id"), c("b").alias("component")).distinct())
