"""Hard negatives by Strassen products of anchor tiles with candidate tiles.

Vectors are whole numbers; rows of one label and length are dealt into tiles of about ``TILE``
candidates and ``ANCHORS`` anchors. A task multiplies one anchor tile with one candidate tile by
Strassen's recursion (seven products of halves, padded with zeros) and keeps for each anchor a heap of
its best scores; heaps of the tiles merge by taking the best of them again.

The first pass meets tiles of the same label only and yields the positives of every anchor. With
their scores known, the second meets tiles of other labels and yields for each anchor and positive the
best negatives whose score lies in its window.

All sums and products are exact: a tile whose scores could leave 64 bits is worked off in
unbounded integers.

Defined results: rows with a null key or label, or a vector that is null, empty or holds a null or
non-finite component take no part; vectors of different lengths are not compared; a row is no
positive of its own, but may be of another row with the same key; equal scores are ordered by the
smaller key; an anchor without positives or a positive without negatives gives no rows; scores beyond
a long are held at its ends; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piitrace.session import cut

#: Candidates and anchors of a tile, about.
TILE, ANCHORS = 4096, 512
#: No side of a product that is split further may be shorter.
LEAF = 16
#: Anchors whose scores are ordered at a time.
ORDERED = 64
#: Parts in which the numbers of anchor tiles and candidate tiles are paired.
SALTS = 32
LARGEST = (1 << 63) - 1


def _even(a: np.ndarray) -> np.ndarray:
    """A matrix with a row or column of zeros more where it has an odd number of them."""
    m, n = a.shape
    if m % 2 == n % 2 == 0:
        return a
    out = np.zeros((m + m % 2, n + n % 2), a.dtype)
    out[:m, :n] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices of whole numbers; odd sides are padded with zeros."""
    m, d = a.shape
    n = b.shape[1]
    if min(m, d, n) < 2 * LEAF:
        return a @ b
    a, b = _even(a), _even(b)
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * k), p1.dtype)
    out[:i, :k] = p1 + p4 - p5 + p7
    out[:i, k:] = p3 + p5
    out[i:, :k] = p2 + p4
    out[i:, k:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices, exact; beyond 64 bits at their ends.

    A level of the recursion at most doubles the entries on both sides and sums up four products.
    """
    levels = max(1, min(a.shape[0], a.shape[1], b.shape[0])).bit_length()
    bound = a.shape[1] * (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1)
    if bound << 4 * levels <= LARGEST:
        return strassen(a.astype(np.int64), np.ascontiguousarray(b.T.astype(np.int64)))
    wide = strassen(a.astype(object), np.ascontiguousarray(b.T.astype(object)))
    return np.clip(wide, -LARGEST, LARGEST).astype(np.int64)


def _whole(values: list[list[float]]) -> np.ndarray:
    """Whole numbers given as doubles, as integers of 64 bits or, if need be, of any size."""
    out = np.array(values, np.float64)
    if np.abs(out).max(initial=0) < 1 << 62:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object)


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: int = 256) -> DataFrame:
    """For each row where ``anchors`` holds and each of its best ``positives`` of the same label, the best
    ``negatives`` of other labels whose score is at least ``low`` and at most ``high`` hundredths of
    the positive's: ``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``,
    ``positive_score`` and ``negative_score``. Components count as ``floor(scale * x)``."""
    c = F.col
    chosen = df.select(F.monotonically_increasing_id().alias("row"), df[key].cast("long").alias("key"),
                       df[label].alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
                       df[vector].cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # floor() gives a long; doubles beyond it are whole numbers as they are.
    ints = F.transform("vec", lambda x: F.when(F.abs(x * scale) < float(1 << 53), F.floor(x * scale).cast(
        "double")).otherwise(x * scale))
    rows = cut(chosen.where("key is not null and label is not null and vec is not null and size(vec) > 0").where(
        ~bad).select("row", "key", "label", "anchor", F.size("vec").alias("dims"), ints.alias("vec")), "vectors")
    counted = rows.groupBy("dims", "label").agg(
        F.ceil(F.count("*") / TILE).alias("tiles"),
        F.greatest(F.ceil(F.count_if("anchor") / ANCHORS), F.lit(1)).alias("asked"))
    dealt = rows.join(counted, ["dims", "label"])

    def tiled(of: DataFrame, n: str) -> DataFrame:
        item = F.struct("key", "row", "vec")
        return of.withColumn("tile", F.pmod(F.xxhash64("row"), c(n))).groupBy("dims", "label", "tile").agg(
            F.sort_array(F.collect_list(item)).alias("items"))

    tiles = cut(tiled(dealt, "tiles"), "tiles")
    asked = cut(tiled(dealt.where("anchor"), "asked").select(
        "dims", "label", c("tile").alias("asked"), c("items").alias("anchors")), "anchors")

    def unpack(items: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = items.values
        keys, own = flat.field("key").to_numpy(), flat.field("row").to_numpy()
        lists = flat.field("vec")
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        return keys, own, _whole(values)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best scores of each anchor in a tile of its own label."""
        for batch in batches:
            for i in range(batch.num_rows):
                keys, own, a = unpack(batch.column(0)[i])
                other, rows_of, b = unpack(batch.column(1)[i])
                score = products(a, b)
                out = []
                for j in range(len(a)):
                    best = np.argsort(-score[j], kind="stable")[:positives + 1]
                    best = best[rows_of[best] != own[j]][:positives]
                    out += [(own[j], rows_of[x], other[x], score[j, x]) for x in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], pa.int64()) for k in range(4)],
                    names=["anchor", "row", "key", "score"])

    pairs = asked.join(counted.select("dims", "label", "tiles"), ["dims", "label"]).withColumn(
        "tile", F.explode(F.sequence(F.lit(0).cast("long"), c("tiles") - 1)))
    found = pairs.join(tiles, ["dims", "label", "tile"]).select("anchors", "items").mapInArrow(
        nearest, "anchor long, row long, key long, score long")
    best = Window.partitionBy("anchor").orderBy(c("score").desc(), "key", "row")
    found = cut(found.withColumn("rank", F.row_number().over(best)).where(c("rank") <= positives), "positives")

    # Anchors with the scores they ask about: at most `positives` of them for each.
    wanted = found.select(c("anchor").alias("of"), "score", "key", "row").groupBy("of").agg(F.sort_array(F.collect_list(
        F.struct("score", "key", "row"))).alias("wanted"))
    asking = dealt.where("anchor").join(wanted, c("row") == c("of")).select(
        "dims", "label", F.pmod(F.xxhash64("row"), c("asked")).alias("asked"),
        F.struct("key", "row", "vec", "wanted").alias("item"))
    asking = cut(asking.groupBy("dims", "label", "asked").agg(F.sort_array(F.collect_list("item")).alias(
        "anchors")), "asking")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each anchor and positive the best scores of its window in a tile of another label."""
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column(0)[i]
                keys, own, a = unpack(cell)
                wants = cell.values.field("wanted").to_pylist()
                other, _, b = unpack(batch.column(1)[i])
                out: list[tuple] = []
                for begin in range(0, len(a), ORDERED):
                    score = products(a[begin:begin + ORDERED], b)
                    order = np.argsort(-score, axis=1, kind="stable")
                    falling = -np.take_along_axis(score, order, 1)
                    for j, (places, values) in enumerate(zip(order, falling, strict=True)):
                        for w in wants[begin + j]:
                            least = -(-low * w["score"] // 100)
                            most = high * w["score"] // 100
                            if least > most:
                                continue
                            x = int(np.searchsorted(values, -min(most, LARGEST), "left"))
                            y = int(np.searchsorted(values, -max(least, -LARGEST), "right"))
                            for at in range(x, min(y, x + negatives)):
                                out.append((own[begin + j], keys[begin + j], w["row"], w["key"], w["score"],
                                            other[places[at]], -values[at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], pa.int64()) for k in range(7)],
                    names=["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative_id",
                           "negative_score"])

    # Every anchor tile meets every tile of another label. Their numbers are paired first, in `SALTS`
    # parts of the one length there is; then anchors travel, being the smaller tiles.
    salt = F.pmod(F.xxhash64("of", "tile"), F.lit(SALTS))
    index = tiles.select("dims", c("label").alias("of"), "tile").withColumn("salt", salt)
    numbers = asking.select("dims", "label", "asked", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = numbers.join(index, ["dims", "salt"]).where("label <> of").join(
        asking, ["dims", "label", "asked"]).select("dims", "of", "tile", "anchors").join(
        tiles.withColumnRenamed("label", "of"), ["dims", "of", "tile"]).select("anchors", "items")
    heaps = met.mapInArrow(windows, "anchor long, anchor_id long, positive long, positive_id long, "
                           "positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "positive").orderBy(c("negative_score").desc(), "negative_id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(c("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
