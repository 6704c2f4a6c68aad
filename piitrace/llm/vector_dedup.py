"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Hadamard transform. A hash is the axis, with its
sign, nearest to the rotated vector; ``FUNCTIONS`` of them make a bucket, and there are ``TABLES``
tables. Besides its own bucket a vector enters those in which one hash is the second nearest
axis. Two vectors at cosine 0.9 in 64 dimensions share a bucket with probability 0.999.

Equal vectors are one class with a count from the start. Buckets with one class are dropped. In the
others the signs of ``BITS`` random projections are compared first: most buckets hold vectors that only
happen to meet, and members none of whose partners agrees in enough signs leave before any vector is
sent. A pair at the wanted cosine disagrees in more signs than ``DEVIATIONS`` allow once in millions.
What stays is compared as blocks of a matrix product, large buckets in pairs of sub-blocks. A block
returns a row per vector: how many others it links, and the smallest class of its links within the
block. Pairs never become rows. A pair that meets in several buckets counts in the first.

Defined results: null, empty and zero vectors and those with null or non-finite components link
with nothing; vectors of different lengths are not compared; rows with equal ids are vectors of
their own and are compared; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piitrace.llm.components import components
from piitrace.llm.vectors import matrix, packed, unit
from piitrace.session import cut, drop

TABLES, FUNCTIONS = 12, 3
#: Buckets of a vector in one table: its own and one for each hash.
PROBES = 1 + FUNCTIONS
#: Vectors of a sub-block.
BLOCK = 1024
#: Signs of a sketch, and by how many deviations similar vectors may differ in more of them than expected.
BITS, DEVIATIONS = 256, 5
#: Members of a bucket up to which all buckets of a batch are looked at together.
SMALL = 8


@cache
def _signs(table: int, dims: int) -> np.ndarray:
    return np.random.default_rng([table, dims]).choice([-1.0, 1.0], size=(FUNCTIONS, 3, dims))


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row; the length is a power of two."""
    n, dims = rows.shape
    half = 1
    while half < dims:
        pairs = rows.reshape(n, -1, 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2
                        ).reshape(n, dims)
        half *= 2
    return rows / np.sqrt(dims)


def buckets(rows: np.ndarray) -> np.ndarray:
    """For unit vectors, their buckets: an array of (vectors, TABLES * PROBES) numbers."""
    n, own = rows.shape
    dims = max(2, 1 << (own - 1).bit_length())
    rows = np.pad(rows, [(0, 0), (0, dims - own)])
    out = np.empty((n, TABLES, PROBES), np.int64)
    for table in range(TABLES):
        near = []
        for signs in _signs(table, dims):
            turned = rows
            for s in signs:
                turned = hadamard(turned * s)
            both = np.concatenate([turned, -turned], axis=1)
            top = np.argpartition(-both, 1, axis=1)[:, :2]
            order = np.take_along_axis(-both, top, 1).argsort(axis=1)
            near.append(np.take_along_axis(top, order, 1))
        for probe in range(PROBES):
            code = np.full(n, table, np.int64)
            for f in range(FUNCTIONS):
                code = code * (2 * dims) + near[f][:, 1 if probe == f + 1 else 0]
            out[:, table, probe] = code
    # Vectors of different lengths never share a bucket.
    return out.reshape(n, -1) * 8191 + own


@cache
def _projections(dims: int) -> np.ndarray:
    return np.random.default_rng([dims, BITS]).normal(size=(dims, BITS))


def sketches(rows: np.ndarray) -> np.ndarray:
    """The signs of each row's projections, as 64-bit words."""
    return np.packbits(rows @ _projections(rows.shape[1]) > 0, axis=1).view(np.uint64)


def most_apart(least: float) -> int:
    """Signs in which vectors at the cosine ``least`` differ at most."""
    share = np.arccos(np.clip(least, -1, 1)) / np.pi
    return int(np.ceil(BITS * share + DEVIATIONS * np.sqrt(BITS * share * (1 - share)) + 1))


def _hashed(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2)
            sizes = np.array([len(b.as_buffer()) for b in blobs])
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                rows = unit(matrix(part.column(2)))
                codes = buckets(rows)
                bounds = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(codes.ravel()))
                signs = pa.array([x.tobytes() for x in sketches(rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, signs],
                                                 names=["class", "times", "vec", "codes", "signs"])

    return classes.select("class", "times", "vec").mapInArrow(
        run, "class long, times long, vec binary, codes array<long>, signs binary")


def _met_before(x: np.ndarray, y: np.ndarray, code: int) -> np.ndarray:
    """For pairs of bucket lists, whether they share a bucket that comes before ``code``.

    Buckets come in the order of their tables, then of their numbers."""
    hit = (x == code)
    table = int(np.argmax(hit.any(axis=0))) // PROBES if len(x) else 0
    met = np.zeros(len(x), bool)
    for t in range(table + 1):
        left = np.flatnonzero(~met)
        if not len(left):
            break
        a = x[left, t * PROBES:(t + 1) * PROBES]
        b = y[left, t * PROBES:(t + 1) * PROBES]
        same = np.zeros(len(left), bool)
        for i in range(PROBES):
            equal = (a[:, i:i + 1] == b).any(axis=1)
            same |= equal & (a[:, i] < code) if t == table else equal
        met[left[same]] = True
    return met


def _block(ids: np.ndarray, times: np.ndarray, rows: np.ndarray, codes: np.ndarray, code: int,
           side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within a bucket: the members with links, the vectors each links and the smallest member of
    its group. With two sides only pairs across them are new."""
    two = side.any() and not side.all()
    a = np.flatnonzero(side == 0) if two else np.arange(len(ids))
    b = np.flatnonzero(side == 1) if two else a
    count = np.zeros(len(ids), np.int64)
    group = np.arange(len(ids))
    links = rows[a] @ rows[b].T >= least
    i, j = np.nonzero(links)
    i, j = a[i], b[j]
    if not two:
        keep = i < j
        i, j = i[keep], j[keep]
    for begin in range(0, len(i), 1 << 18):
        x, y = i[begin:begin + (1 << 18)], j[begin:begin + (1 << 18)]
        new = ~_met_before(codes[x], codes[y], code)
        np.add.at(count, x[new], times[y[new]])
        np.add.at(count, y[new], times[x[new]])
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    group = rank.copy()
    while len(i):
        low = group.copy()
        np.minimum.at(low, i, group[j])
        np.minimum.at(low, j, group[i])
        low = low[order[low]]  # follow the smallest one's smallest
        if (low == group).all():
            break
        group = low
    at = np.unique(np.concatenate([i, j]))
    return at, count[at], ids[order[group[at]]]


def near_members(signs: np.ndarray, side: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """For the members of buckets, which begin at ``start``, whether one they meet differs in at most
    ``most`` signs. In a bucket with two sides only members of different sides meet."""
    n = len(signs)
    out = np.zeros(n, bool)
    length = np.diff(np.append(start, n))
    bucket = np.repeat(np.arange(len(start)), length)
    two = np.add.reduceat(side, start)
    two = np.repeat((two > 0) & (two < length), length) if n else two
    small = np.repeat(length <= SMALL, length)
    for step in range(1, SMALL):
        i = np.flatnonzero(small[:-step] & (bucket[:-step] == bucket[step:])) if step < n else np.zeros(0, np.int64)
        j = i + step
        keep = ~two[i] | (side[i] != side[j])
        i, j = i[keep], j[keep]
        near = np.bitwise_count(signs[i] ^ signs[j]).sum(axis=1) <= most
        out[i[near]] = out[j[near]] = True
    for b in np.flatnonzero(length > SMALL).tolist():
        at = np.arange(start[b], start[b] + length[b])
        x = at[side[at] == 0] if two[at[0]] else at
        y = at[side[at] == 1] if two[at[0]] else at
        bits = np.unpackbits(signs[at].view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        near = bits[x - at[0]] @ bits[y - at[0]].T >= BITS - 2 * most
        if not two[at[0]]:
            np.fill_diagonal(near, False)
        out[x[near.any(axis=1)]] = True
        out[y[near.any(axis=0)]] = True
    return out


def _plausible(placed: DataFrame, least: float) -> DataFrame:
    """The members of buckets that meet one with similar signs: (code, low, high, side, class)."""
    most = most_apart(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            change = changes(held)
            if len(change) > 1:
                yield done(held.slice(0, int(change[-1])))
                held = held.slice(int(change[-1]))
        if held is not None:
            yield done(held)

    def changes(table: pa.Table) -> np.ndarray:
        keys = [table.column(n).to_numpy() for n in ("code", "low", "high")]
        return np.flatnonzero(np.append([True], np.any([k[1:] != k[:-1] for k in keys], axis=0)))

    def done(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        signs = np.frombuffer(b"".join(table["signs"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
        keep = near_members(signs, table["side"].to_numpy().astype(np.int64), changes(table), most)
        return table.select(["code", "low", "high", "side", "class"]).combine_chunks().to_batches()[0].filter(
            pa.array(keep))

    return placed.repartition("code", "low", "high").sortWithinPartitions("code", "low", "high").select(
        "code", "low", "high", "side", "class", "signs").mapInArrow(
        run, "code long, low int, high int, side int, class long")


def _compare(placed: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = [held.column(n).to_numpy() for n in ("code", "low", "high")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(change):
                yield from done(held.slice(0, int(change[-1])), change[:-1])
                held = held.slice(int(change[-1]))
        if held is not None:
            yield from done(held, np.zeros(0, np.int64))

    def done(table: pa.Table, change: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        col = {n: table.column(n).chunk(0) for n in table.column_names}
        ids, times, side, code = (col[n].to_numpy() for n in ("class", "times", "side", "code"))
        found = []
        for begin, end in zip([0, *change.tolist()], [*change.tolist(), len(ids)], strict=True):
            if end - begin < 2:
                continue
            part = slice(begin, end)
            rows = unit(matrix(col["vec"].slice(begin, end - begin)))
            codes = col["codes"].slice(begin, end - begin).flatten().to_numpy().reshape(len(rows), -1)
            at, count, low = _block(ids[part], times[part], rows, codes, int(code[begin]), side[part],
                                    least)
            if len(at):
                found.append((ids[part][at], count, low))
        if found:
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns],
                                             names=["class", "links", "low"])

    return placed.repartition("code", "low", "high").sortWithinPartitions("code", "low", "high").select(
        "code", "low", "high", "side", "class", "times", "vec", "codes").mapInArrow(
        run, "class long, links long, low long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9
                    ) -> DataFrame:
    """A row per vector: ``key``, ``n_links`` (other vectors found at this cosine or above),
    ``component_id`` (smallest key reachable by links) and ``kept`` (it is that key itself)."""
    c = F.col
    rows = cut(packed(df, key, vector), "vectors")
    equal = rows.where("vec is not null").groupBy("vec").agg(
        F.min("row").alias("class"), F.count("*").alias("times"))
    hashed = cut(_hashed(equal), "buckets")
    entries = hashed.select("class", F.explode("codes").alias("code")).distinct()
    sizes = entries.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(c("n") / BLOCK).cast("int")
    full = entries.join(sizes, "code").select(
        "code", "class", parts.alias("parts"), F.pmod(F.xxhash64("class"), parts).cast("int").alias("own"))
    pairs = full.select("code", "class", "own", F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("other"))
    pairs = pairs.select("code", "class", F.least("own", "other").alias("low"),
                         F.greatest("own", "other").alias("high"),
                         (c("own") > c("other")).cast("int").alias("side"))
    near = cut(_plausible(pairs.join(hashed.select("class", "signs"), "class"), least), "members")
    found = cut(_compare(near.join(hashed.drop("signs"), "class"), least), "links")
    drop(near, hashed)

    linked = found.groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.select(c("class").alias("a"), c("low").alias("b"))).select(
        c("id").alias("class"), "component")
    members = rows.join(equal, "vec", "left").select("row", "key", "class", "times")
    out = members.join(linked, "class", "left").join(groups, "class", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.coalesce(c("times") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("component", "class", "row").alias("component"))
    least_key = out.groupBy("component").agg(F.min("key").alias("component_id"))
    return out.join(least_key, "component").select(
        c("key").alias(key), "n_links", "component_id", c("key").eqNullSafe(c("component_id")).alias("kept"))
