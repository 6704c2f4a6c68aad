"""Nearest neighbours by collision counting over sorted projections.

The index keeps, for each of ``LINES`` random directions, its vectors in the order of their
projection. A query opens a window around its own projection on every line; a vector collides on
a line once it lies in the window. Virtual rehashing widens the windows: from level to level only
the vectors between the old and the new edges are walked, from the sorted arrays. A vector that
collides on ``ENOUGH`` of the lines is verified on the original vectors.

A query stops by quality: the windows are wide enough for its radius, the distance of the
``k``-th best vector known, if a vector at that distance collides on enough lines with a margin of
``SURE`` deviations. A first pass over ``SAMPLE`` vectors tells every query such a radius; with it, the
second pass opens each window at the width that it needs.

The index is dealt by coarse cells, the nearest of at most ``CELLS`` vectors chosen by a hash; a large
cell is split by hash. A query leaves out blocks whose ball cannot hold anything that good: the inner
product with a block's vectors is at most that with its centre plus length times radius. A task sorts
the projections of a block once for up to ``TOGETHER`` blocks of queries.

Nearness is the inner product. Distances follow it once every vector has the same length, so
indexed vectors get one more component that lengthens them to the longest; queries get 0 there.

Defined results: vectors that are null, empty, zero or have null or non-finite components take no
part; vectors of different lengths are not compared; a row is no neighbour of its own, but is of
another row with the same id; equal scores are ordered by the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from piitrace.llm.vectors import matrix, packed
from piitrace.session import cut, drop

#: Vectors of an index block, queries of a block, and blocks of queries that meet an index block in one task.
BLOCK, QUERIES, TOGETHER = 4096, 512, 64
#: Most coarse cells, and vectors of the first pass, about.
CELLS, SAMPLE = 1024, 16384
LINES = 128
#: Share of the lines on which a candidate collides, and by how many deviations more a vector at the
#: radius is expected to.
ENOUGH, SURE = 0.88, 1.0
#: First half width of the windows and its growth, in the lengths of the vectors.
FIRST, GROW = 1.0, 1.25
#: Parts in which the numbers of blocks are paired.
SALTS = 32
FOUND = "query_row long, query_id long, row long, key long, score double"


@lru_cache(maxsize=8)
def _lines(dims: int) -> np.ndarray:
    """Random directions of ``dims`` components, in groups that are at right angles to each other. Projections
    of vectors of length one have a variance of one."""
    rng = np.random.default_rng(dims)
    groups = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(-(-LINES // dims))]
    return np.concatenate(groups, axis=1)[:, :LINES] * math.sqrt(dims)


def _reach() -> float:
    """The half width of a window, in radii, at which a vector at the radius collides often enough."""
    share = ENOUGH + SURE * math.sqrt(ENOUGH * (1 - ENOUGH) / LINES)
    return NormalDist().inv_cdf((1 + min(share, 0.999)) / 2)


class Index:
    """A block of vectors with its sorted projections."""

    def __init__(self, rows: np.ndarray, longest: float):
        self.rows, self.longest = rows, longest
        rest = np.sqrt(np.maximum(0.0, 1 - ((rows / longest) ** 2).sum(axis=1)))
        self.lines = _lines(rows.shape[1] + 1)
        places = np.ascontiguousarray((np.column_stack([rows / longest, rest]) @ self.lines).T)
        order = np.argsort(places, axis=1)
        #: The lines one behind the other, far enough apart for one search: places and vectors in their order.
        self.apart = 64.0 * math.sqrt(rows.shape[1] + 1) * np.arange(LINES)
        self.places = (np.take_along_axis(places, order, 1) + self.apart[:, None]).ravel()
        self.order = order.ravel()
        self.first = np.arange(LINES) * len(rows)
        self.centre = rows.mean(axis=0)
        self.radius = float(np.sqrt(((rows - self.centre) ** 2).sum(axis=1)).max())
        #: Vectors that were verified, for all queries.
        self.verified = 0

    def edges(self, projected: np.ndarray, width: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
        """Where each line's window begins and ends in the order of all lines."""
        at = projected + self.apart
        return np.searchsorted(self.places, at - width), np.searchsorted(self.places, at + width, "right")

    def walked(self, *stretches: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How often each vector stands in these stretches of the order."""
        parts = [self.order[a:b] for begin, end in stretches
                 for a, b in zip(begin.tolist(), end.tolist(), strict=True) if a < b]
        if not parts:
            return np.zeros(len(self.rows), np.int64)
        return np.bincount(np.concatenate(parts), minlength=len(self.rows))

    def search(self, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int,
               known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number, the places of its best vectors and their inner products. ``known`` are inner
        products of which each query has ``k`` as good ones already; worse vectors are left out."""
        n = len(ids)
        norms = np.sqrt((queries ** 2).sum(axis=1))
        projected = (queries / norms[:, None]) @ self.lines[:-1]
        most = queries @ self.centre + norms * self.radius
        least, reach = math.ceil(ENOUGH * LINES), _reach()
        lengths = norms * self.longest
        last = self.first + n
        bounds = np.full(len(queries), -np.inf) if known is None else known
        widths = np.where(np.isfinite(bounds), reach * np.sqrt(np.maximum(
            0.0, 2 - 2 * np.where(np.isfinite(bounds), bounds, 0.0) / lengths)) + 1e-9, FIRST)
        lows, highs = self.edges(projected, widths[:, None])
        for i, query in enumerate(queries):
            bound = float(bounds[i])
            if most[i] < bound - 1e-9 * lengths[i]:
                continue

            def needed(score: float) -> float:
                """The width for a radius, given as an inner product."""
                return reach * math.sqrt(max(0.0, 2 - 2 * score / lengths[i])) + 1e-9  # noqa: B023

            width, low, high = float(widths[i]), lows[i], highs[i]
            missed = self.walked((self.first, low), (high, last))
            passed = missed <= LINES - least
            found = np.flatnonzero(passed & (own != query_rows[i]))
            score = self.rows[found] @ query
            while True:
                best = bound
                if len(score) >= k:
                    best = max(bound, float(np.partition(score, len(score) - k)[len(score) - k]))
                if width >= needed(best) if best > -np.inf else not missed.any():
                    break
                # Walk outward: what lies between the edges collides on one line more.
                width = min(width * GROW, needed(best)) if best > -np.inf else width * GROW
                before = low, high
                low, high = self.edges(projected[i], width)
                missed -= self.walked((low, before[0]), (before[1], high))
                fresh = np.flatnonzero(~passed & (missed <= LINES - least) & (own != query_rows[i]))
                passed[fresh] = True
                found = np.concatenate([found, fresh])
                score = np.concatenate([score, self.rows[fresh] @ query])
            self.verified += len(found)
            good = score >= bound
            found, score = found[good], score[good]
            order = np.lexsort((ids[found], -score))[:k]
            yield i, found[order], score[order]


def _blocks(rows: DataFrame, block: list[str], names: tuple[str, ...], more: tuple[str, ...] = ()) -> DataFrame:
    """One row per block with its vectors in one binary, its numbers and the doubles ``more`` in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            of = [held.column(n).to_numpy() for n in (*block, "dims")]
            change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in of], axis=0)) + 1
            for begin, end in zip([0, *change[:-1]], change, strict=False):
                yield one(held.slice(begin, end - begin))
            if len(change):
                held = held.slice(int(change[-1]))
        if held is not None and held.num_rows:
            yield one(held)

    def one(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        blobs = [np.ascontiguousarray(part.column(n).to_numpy(), t).tobytes()
                 for n, t in (("key", "<i8"), ("row", "<i8"), *((m, "<f8") for m in more))]
        blobs.append(b"".join(b.as_py() for b in part.column("vec").chunk(0)))
        return pa.RecordBatch.from_arrays(
            [*(pa.array([part[n][0].as_py()], pa.int64()) for n in block),
             pa.array([part["dims"][0].as_py()], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)],
            names=[*block, "dims", *names])

    dealt = rows.select(*block, F.length("vec").alias("dims"), "key", "row", *more, "vec").repartition(
        *block, "dims").sortWithinPartitions(*block, "dims", "row")
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in block) + ", dims int, "
                            + ", ".join(f"{n} binary" for n in names))


def _cells(rows: DataFrame, count: int) -> DataFrame:
    """``rows`` with ``cell``, the nearest of some vectors of their length. No more than ``CELLS`` vectors are
    sent to every task."""
    wanted = min(CELLS, -(-count // BLOCK))
    chosen = rows.where(F.pmod(F.xxhash64("row", F.lit(2)), F.lit(max(1, count // (2 * wanted)))) == 0).select(
        "row", "vec").orderBy(F.xxhash64("row", F.lit(3))).limit(wanted).toArrow()
    by_size: dict[int, list[bytes]] = {}
    for blob in chosen["vec"].to_pylist():
        by_size.setdefault(len(blob), []).append(blob)
    sent = rows.sparkSession.sparkContext.broadcast({n: b"".join(b) for n, b in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = {n: np.frombuffer(b, "<f8").reshape(-1, n // 8) for n, b in sent.value.items()}
        for batch in batches:
            vecs = batch.column("vec")
            size = pc.binary_length(vecs).to_numpy()
            cell = np.zeros(len(size), np.int64)
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                if n in centres:
                    c = centres[n]
                    near = matrix(vecs.take(pa.array(at))) @ c.T - (c ** 2).sum(axis=1) / 2
                    cell[at] = near.argmax(axis=1)
            yield batch.append_column("cell", pa.array(cell))

    return rows.mapInArrow(run, "row long, key long, query boolean, vec binary, cell long")


def search(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding"
           ) -> DataFrame:
    """For each row of ``df`` where ``queries`` holds, its ``k`` nearest other rows: ``query_id``,
    ``rank`` from 1, ``key`` and ``score``."""
    c = F.col
    both = packed(df.select(
        F.struct(df[key].cast("long").alias("key"), F.coalesce(queries, F.lit(False)).alias("query")
                 ).alias("key"), df[vector].alias("vec")), "key", "vec")
    rows = cut(both.where("vec is not null and key.key is not null").select(
        "row", "key.key", c("key.query").alias("query"), "vec"), "vectors")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(np.sqrt((np.frombuffer(b.as_buffer(), "<f8") ** 2).sum()))
                           for b in batch.column(0)], pa.float64())], names=["norm"])

    count, asked_count = rows.agg(F.count("*"), F.sum(c("query").cast("long"))).first()
    if not count or not asked_count:
        return df.sparkSession.createDataFrame(
            [], f"query_id long, rank int, {key} long, score double")
    longest = rows.select("vec").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    part = lambda n: F.pmod(F.xxhash64("row"), n).cast("long")
    best = Window.partitionBy("query_row").orderBy(c("score").desc(), "key")

    def nearest(index: DataFrame, asked: DataFrame, n_asked: int, bounded: bool) -> DataFrame:
        """Up to ``k`` good vectors of every block of the index for each query."""
        groups = -(-n_asked // TOGETHER)
        group = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        names = ["cell", "block", "dims"]
        number = c("asked") % groups
        empty = F.lit(None).cast("binary")
        tiles = index.select(*names, group(groups).alias("group"), F.lit(-1).cast("long").alias("asked"), "ids", "own",
                             empty.alias("known"), "data")
        # Numbers are paired first, in `SALTS` parts of the one length there is; then queries travel.
        salt = F.pmod(F.xxhash64("cell", "block"), F.lit(SALTS)).cast("long")
        pairs = asked.select("dims", "asked", group(SALTS).alias("salt")).join(
            index.select(*names, salt.alias("salt")), ["dims", "salt"]).drop("salt")
        probes = pairs.join(asked, ["dims", "asked"]).select(
            *names, number.alias("group"), "asked", c("q_ids").alias("ids"), c("q_own").alias("own"),
            c("known") if bounded else empty.alias("known"), c("q_data").alias("data"))
        met = tiles.unionByName(probes).repartition(*names, "group").sortWithinPartitions(*names, "group", "asked")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = ids = own = None
            for batch in batches:
                for row in range(batch.num_rows):
                    cell = {n: batch.column(n)[row] for n in batch.schema.names}
                    array = lambda n, t="<i8": np.frombuffer(cell[n].as_buffer(), t)  # noqa: B023, E731
                    vectors = array("data", "<f8").reshape(-1, cell["dims"].as_py() // 8)
                    if cell["asked"].as_py() < 0:
                        block, ids, own = Index(vectors, longest), array("ids"), array("own")
                        continue
                    known = array("known", "<f8") if cell["known"].is_valid else None
                    out = list(block.search(ids, own, vectors, array("own"), k, known))
                    if out:
                        at = np.repeat([i for i, _, _ in out], [len(b) for _, b, _ in out])
                        place = np.concatenate([b for _, b, _ in out])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(array("own")[at]), pa.array(array("ids")[at]), pa.array(own[place]),
                             pa.array(ids[place]), pa.array(np.concatenate([s for _, _, s in out]))],
                            names=["query_row", "query_id", "row", "key", "score"])

        return met.select("dims", "asked", "ids", "own", "known", "data").mapInArrow(run, FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(c("rank") <= k)

    n_asked = -(-asked_count // QUERIES)
    asking = rows.where("query").withColumn("asked", part(F.lit(n_asked)))
    sampled = -(-count // SAMPLE)
    sample = rows if sampled == 1 else rows.where(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(sampled)) == 0)
    n_sample = max(1, -(-min(count, SAMPLE) // BLOCK))
    first = _blocks(sample.withColumn("cell", F.lit(0).cast("long")).withColumn("block", part(F.lit(n_sample))),
                    ["cell", "block"], ("ids", "own", "data"))
    asked = cut(_blocks(asking, ["asked"], ("q_ids", "q_own", "q_data")), "queries")
    told = cut(ranked(nearest(cut(first, "sample"), asked, n_asked, False)), "told")
    if sampled == 1:
        return told.select("query_id", "rank", c("key").alias(key), "score")

    known = told.where(c("rank") == k).select(c("query_row").alias("row"), c("score").alias("known"))
    asking = asking.join(known, "row", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
    bounded = cut(_blocks(asking, ["asked"], ("q_ids", "q_own", "known", "q_data"), ("known",)), "bounded")
    celled = cut(_cells(rows, count), "cells")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    index = cut(_blocks(celled.join(sizes, "cell").withColumn("block", part(c("blocks"))), ["cell", "block"],
                        ("ids", "own", "data")), "index")
    drop(asked, celled)
    # The second pass may miss what the first one found.
    found = nearest(index, bounded, n_asked, True).unionByName(told.drop("rank")).dropDuplicates(["query_row", "row"])
    return ranked(found).select("query_id", "rank", c("key").alias(key), "score")
