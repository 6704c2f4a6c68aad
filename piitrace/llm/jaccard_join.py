"""Size-aware heavy-light join of word-shingle sets by Jaccard similarity.

Sets are light up to a boundary size, else heavy. Two light sets that are similar share a
subset of two shingles among their rarest, so every such subset of a light set is a signature.
A heavy set is found by scanning inverted lists: its rarest shingles are signatures by themselves,
as are those of light sets just below the boundary. How many of the rarest are needed follows
from the similarity: sets with an overlap of at least ``o`` share ``l`` of the first
``size - o + l`` in any order of all shingles. The boundary is the size at which the rows of
both kinds, list scans included, are fewest; sizes of all sets and the list lengths of the
rarest among a hash-chosen share of all shingles say how many rows there would be.

Rare is what a count sketch over all sets says; any order would be right, a good one keeps
the lists of shared passages short. Equal sets are one class from the start. Lists are
worked off in three steps, so that large groups of near copies do not make all their pairs:

1. each member of a list is compared with the list's first;
2. then with one that a hash chooses, if they are in different components of the links found;
3. what is still in different components is compared across them, in blocks of a fixed size.

Before signatures are shuffled, a filter of fixed size drops most of those that only one class has:
tasks say which positions their signatures fall on, and a position that two classes fall on passes.
It only ever keeps too many. Where there are so many signatures that it would keep nearly all, it
is left out.

A candidate pair first meets a bound: each set has a bitmap of its shingles, and sets differ
at least in as many shingles as their bitmaps in bits. Those that pass are counted exactly.

Shingles are 64-bit numbers of five words, and a class is known by a 64-bit number of its
set and its size.

Defined results: a text with fewer words is one shingle; null and empty texts have none and are
linked with nothing; rows with equal keys and texts are one row, equal keys with different
texts are linked by the key and have the larger size; rows with a null key come out
unlinked; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piitrace.llm.components import components
from piitrace.llm.words import UNSPACED, mix, scan, windows
from piitrace.session import cut, drop, tidy

#: Words of a shingle, and the similarity from which sets link, in hundredths.
SHINGLE, LEAST = 5, 75
#: Counters of the rarity sketch, and the parts in which they travel.
COUNTERS, PARTS = 1 << 22, 64
#: One shingle in so many, by its number, is counted exactly for the cost of list scans.
COUNTED = 1024
#: Sizes from which no boundary is tried: their subsets alone are too many.
LARGEST_LIGHT = 256
#: Least and most positions of the filter that says whose sets are needed, powers of two.
WANTED = 1 << 15, 1 << 27
#: Shingles from which half the bits tell sets apart well enough.
LARGE = 1024
#: Positions of the filter of signatures, a power of two, the parts in which they travel, and how many
#: signatures a task gathers before it tells their positions.
SHARED, SHARED_PARTS, TELL = 1 << 28, 64, 1 << 22
#: Members of a list that are compared in one place, where 1024 shingles more count as another.
BLOCK = 1024
#: Words of the bits that say which earlier lists a member is in, looked at in one go.
WIDE = 256


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted distinct shingles of each text, with the text's number."""
    for begin, n, of, number, _, _ in scan(texts, UNSPACED):
        grams, at = windows(number, of, k)
        at = of[at]
        words = np.bincount(of, minlength=n)
        edge = np.searchsorted(at, np.arange(n + 1))
        first = np.searchsorted(of, np.arange(n + 1))
        for i in range(n):
            if words[i] >= k:
                yield begin + i, np.unique(grams[edge[i]:edge[i + 1]])
            elif words[i]:
                own = number[first[i]:first[i + 1]]
                yield begin + i, windows(own, np.zeros(len(own), np.int64), len(own))[0]
            else:
                yield begin + i, np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> int:
    """The number of a set's class."""
    both = mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum() ^ mix(np.array(
        [shingles.sum() + np.uint64(len(shingles))], np.uint64))[0]
    return int(np.uint64(both).view(np.int64))


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle, in a power of two of bits: at least twice as many as there are shingles, or,
    from ``LARGE`` on, at least as many."""
    bits = max(64, 1 << ((1 + (len(shingles) < LARGE)) * len(shingles) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(mix(shingles) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that are in one of two sets only."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) != len(y):
        small, large = (x, y) if len(x) < len(y) else (y, x)
        x, y = small, np.bitwise_or.reduce(large.reshape(-1, len(small)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def overlap(size: int, least: int = LEAST) -> int:
    """Fewest shingles that a set has in common with any similar one."""
    return -(-least * size // 100)


def _measure(docs: DataFrame, k: int) -> DataFrame:
    """Rows of four kinds: (0) each text's class, size and, once per task, bitmap; (1) counts of
    the rarity sketch in parts; (2) exact counts of some shingles."""
    kind = docs.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, counted = np.zeros(COUNTERS, np.uint32), set(), {}
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("kind", pa.int32()), ("key", batch.schema.field(0).type),
                                          ("id", pa.int64()), ("size", pa.int64()),
                                          ("data", pa.binary())])
            ids, sizes, bits = [], [], []
            for _, shingles in shingle_sets(batch.column(1), k):
                own = class_of(shingles)
                new = len(shingles) > 0 and own not in seen
                ids.append(own)
                sizes.append(len(shingles))
                bits.append(bitmap(shingles) if new else None)
                if new:
                    seen.add(own)
                    at, n = np.unique((shingles >> np.uint64(8)) & np.uint64(COUNTERS - 1),
                                      return_counts=True)
                    sketch[at.astype(np.int64)] += n.astype(np.uint32)
                    for s in shingles[mix(shingles) % np.uint64(COUNTED) == 0].tolist():
                        counted[s] = counted.get(s, 0) + 1
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), batch.column(0), pa.array(ids, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], schema=schema)
        if schema is None:
            return
        parts = sketch.astype("<u4").reshape(PARTS, -1)
        some = np.array(list(counted), np.uint64).view(np.int64)
        n, m = PARTS, len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.array([1] * n + [2] * m, pa.int32()), pa.nulls(n + m, schema.field("key").type),
             pa.array([*range(n), *some.tolist()], pa.int64()),
             pa.array([0] * n + list(counted.values()), pa.int64()),
             pa.array([zlib.compress(p.tobytes(), 1) for p in parts] + [None] * m, pa.binary())],
            schema=schema)

    return docs.mapInArrow(run, f"kind int, key {kind.simpleString()}, id long, size long, data binary")


def _sketch(measured: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters: as many numbers as the sketch has, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(zlib.decompress(blob.as_buffer()), "<u4").astype(np.uint64)
                total[part] = total[part] + got if part in total else got
        if total:
            top = np.iinfo(np.uint32).max
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([zlib.compress(np.minimum(t, top).astype("<u4").tobytes(), 1)
                                                  for t in total.values()])], names=["id", "data"])

    parts = measured.where("kind = 1").select("id", "data").repartition(PARTS, "id")
    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint32)
    for r in parts.mapInArrow(run, "id long, data binary").collect():
        out[r.id] = np.frombuffer(zlib.decompress(r.data), "<u4")
    return out.ravel()


def rare_list(lengths: list[tuple[int, int]], least: int = LEAST) -> float:
    """How many others a list has on average, over the rarest shingles that sets are listed under:
    from the lengths of lists and how many there are of each."""
    left = sum(n * times for n, times in lengths) * (100 - least) / 100
    share, met = left, 0.0
    for n, times in sorted(lengths):
        rows = min(left, n * times)
        met += rows * (n - 1)
        left -= rows
    return met / share if share else 0.0


def boundary(sizes: dict[int, int], scan_length: float, least: int = LEAST) -> int:
    """The largest size of a light set, by the rows that lists and subsets would make."""
    tried = range(2, LARGEST_LIGHT)

    def listed(n: int) -> float:
        return sizes.get(n, 0) * (n - overlap(n, least) + 1) * (1 + scan_length)

    def cost(limit: int) -> float:
        near = range(overlap(limit + 1, least), limit + 1)
        light = 0.0
        for n in range(3, limit + 1):
            first = n - overlap(n, least) + 2
            light += sizes.get(n, 0) * first * (first - 1) / 2
        return light + sum(listed(n) for n in near) - sum(listed(n) for n in range(3, limit + 1))

    return min(tried, key=lambda limit: (cost(limit), limit))


def signatures(shingles: np.ndarray, counts: np.ndarray, limit: int, near: int, least: int) -> np.ndarray:
    """The signatures of a set of three shingles or more. Subsets have odd ones, single shingles even ones."""
    n = len(shingles)
    at = (shingles >> np.uint64(8)) & np.uint64(COUNTERS - 1)
    first = n - overlap(n, least)
    counts = counts[at.astype(np.int64)]
    if n > limit and first + 1 < n:  # the rarest, in no order
        rare = shingles[np.argpartition(counts.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64),
                                        first)[:first + 1]]
        return rare & ~np.uint64(1)
    rare = shingles[np.argsort(counts, kind="stable")]
    out = []
    if n <= limit:
        i, j = np.triu_indices(min(first + 2, n), 1)
        out.append(mix(np.minimum(rare[i], rare[j]) * np.uint64(3) + mix(np.maximum(rare[i], rare[j])))
                   | np.uint64(1))
    if n > limit or n >= near:
        out.append(rare[:first + 1] & ~np.uint64(1))
    return np.concatenate(out)


def _signed_sets(batches: Iterator[pa.RecordBatch], counts: np.ndarray, limit: int, k: int, least: int
                 ) -> Iterator[tuple[np.ndarray, int, int]]:
    """Signatures, class and size of each class of a task, once."""
    near, seen = overlap(limit + 1, least), set()
    for batch in batches:
        for _, shingles in shingle_sets(batch.column(0), k):
            # A set of one or two shingles is similar to itself only.
            if len(shingles) > 2 and (own := class_of(shingles)) not in seen:
                seen.add(own)
                yield signatures(shingles, counts, limit, near, least), own, len(shingles)


def _place(sigs: np.ndarray) -> np.ndarray:
    """Positions of signatures in their filter."""
    return (mix(sigs) >> np.uint64(20)) & np.uint64(SHARED - 1)


def _repeated(docs: DataFrame, rarity, limit: int, k: int, least: int) -> dict[int, bytes]:
    """The filter of signatures, a bit for each position that two classes fall on, in compressed parts."""
    part = SHARED // SHARED_PARTS

    def told(places: list[np.ndarray]) -> pa.RecordBatch:
        at, n = np.unique(np.concatenate(places), return_counts=True)
        edge = np.searchsorted(at, np.arange(SHARED_PARTS + 1, dtype=np.uint64) * np.uint64(part))
        rows = [(p, zlib.compress(np.diff(at[x:y], prepend=np.uint64(p * part)).astype("<u4").tobytes(), 1),
                 np.packbits(n[x:y] > 1).tobytes())
                for p, (x, y) in enumerate(zip(edge, edge[1:], strict=False)) if y > x]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([zlib.compress(r[2], 1) for r in rows], pa.binary())], names=["part", "steps", "twice"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, held = [], 0
        for sigs, _, _ in _signed_sets(batches, rarity.value, limit, k, least):
            places.append(_place(np.unique(sigs)))
            held += len(sigs)
            if held > TELL:
                yield told(places)
                places, held = [], 0
        if held:
            yield told(places)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, steps, more in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if p not in once:
                    once[p], twice[p] = np.zeros(part, bool), np.zeros(part, bool)
                steps = np.frombuffer(zlib.decompress(steps.as_buffer()), "<u4")
                more = np.unpackbits(np.frombuffer(zlib.decompress(more.as_buffer()), np.uint8), count=len(steps))
                at = np.cumsum(steps, dtype=np.int64)
                twice[p][at] |= once[p][at] | more.astype(bool)
                once[p][at] = True
        if once:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(twice), pa.int32()),
                 pa.array([zlib.compress(np.packbits(t, bitorder="little").tobytes(), 1) for t in twice.values()])],
                names=["part", "bits"])

    parts = docs.select("text").mapInArrow(tell, "part int, steps binary, twice binary").repartition(
        SHARED_PARTS, "part").mapInArrow(merge, "part int, bits binary")
    # SHARED bits, whatever the input; the driver passes them on as they come, compressed part by part.
    return {r.part: bytes(r.bits) for r in parts.collect()}


_filters: dict[str, np.ndarray] = {}


def _filter(name: str, packed: dict[int, bytes]) -> np.ndarray:
    """The worker's filter of signatures; it keeps the last one."""
    if name not in _filters:
        _filters.clear()
        bits = np.zeros((SHARED_PARTS, SHARED // SHARED_PARTS // 8), np.uint8)
        for part, data in packed.items():
            bits[part] = np.frombuffer(zlib.decompress(data), np.uint8)
        _filters[name] = bits.ravel()
    return _filters[name]


def _postings(docs: DataFrame, rarity, repeated, limit: int, k: int, least: int) -> DataFrame:
    """Signatures of all classes that the filter lets through, once per task: (sig, id, size)."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, sizes, held = [], [], [], 0
        bits = None if repeated is None else _filter(name, repeated.value)
        for out, own, n in _signed_sets(batches, rarity.value, limit, k, least):
            if bits is not None:
                at = _place(out)
                out = out[bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
            sigs.append(out)
            ids.append(own)
            sizes.append(n)
            held += len(out) + 1
            if held > 1 << 18:
                yield _signed(sigs, ids, sizes)
                sigs, ids, sizes, held = [], [], [], 0
        if ids:
            yield _signed(sigs, ids, sizes)

    return docs.select("text").mapInArrow(run, "sig long, id long, size int")


def _signed(sigs: list[np.ndarray], ids: list[int], sizes: list[int]) -> pa.RecordBatch:
    times = [len(s) for s in sigs]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), times)),
         pa.array(np.repeat(np.array(sizes, np.int32), times))], names=["sig", "id", "size"])


def _shared(postings: DataFrame) -> DataFrame:
    """The lists with two members or more, each member once: (sig, id, size, first, first_size, many).
    ``many`` is false only for lists that surely have two members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, told, last = None, True, None  # the first of the list at hand, and whether it is out
        for batch in batches:
            sig, own, size = (col.to_numpy(zero_copy_only=False) for col in batch.columns)
            if not len(sig):
                continue
            fresh = np.ones(len(sig), bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
            if last is not None:
                fresh &= (sig != last[0]) | (own != last[1])
            last = (sig[-1], own[-1])
            sig, own, size = sig[fresh], own[fresh], size[fresh]
            if lead is not None:
                sig, own, size = (np.concatenate([[x], y]) for x, y in
                                  zip(lead, (sig, own, size), strict=True))
            start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
            length = np.diff(np.append(start, len(sig)))
            first = np.repeat(start, length)
            out = np.repeat(length > 1, length)
            open_end = length[-1] == 1
            many = length > 2
            many[0] |= lead is not None and told
            many[-1] = True
            many = np.repeat(many, length)
            if lead is not None:
                if told:
                    out[0] = False
                open_end = open_end and not (told and len(start) == 1)
            lead = (sig[start[-1]], own[start[-1]], size[start[-1]])
            told = not open_end
            if out.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[out]) for x in (sig, own, size.astype(np.int32), own[first],
                                                size[first].astype(np.int32), many)],
                    names=["sig", "id", "size", "first", "first_size", "many"])

    # The JVM sorts and spills; a task then streams through its lists, however long.
    return postings.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(
        run, "sig long, id long, size int, first long, first_size int, many boolean")


def _fits(a: str, b: str, sig: str, limit: int, least: int) -> str:
    """Sizes may be similar, and a single shingle pairs no two light sets."""
    return (f"100 * least({a}, {b}) >= {least} * greatest({a}, {b}) "
            f"and (({sig} & 1) = 1 or greatest({a}, {b}) > {limit})")


def _mixed(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists, without their first members, that are still in several components."""
    rest = lists.where("many and id <> first").join(groups, "id", "left").select(
        "sig", "id", "size", F.coalesce("group", "id").alias("group"))
    mixed = rest.groupBy("sig").agg(F.min("group").alias("g"), F.max("group").alias("h")).where(
        "g <> h").select("sig")
    return cut(rest.join(mixed, "sig", "left_semi"), "mixed")


def _grouped(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, group): the component of every linked class, ``groups`` being those of earlier links."""
    edges = links.select("a", "b").union(groups.select(F.col("id").alias("a"), F.col("group").alias("b")))
    return cut(components(edges).select("id", F.col("component").alias("group")), "groups")


def _pivots(rest: DataFrame, limit: int, least: int) -> DataFrame:
    """Each member of a list with one member chosen by a hash of its own in every list, if they are
    in different components. The lists of a group of near copies choose different ones, so that
    few components of it are left."""
    chosen = rest.groupBy("sig").agg(F.min_by(
        F.struct("id", "size", "group"), F.xxhash64("sig", "id")).alias("p"))
    pairs = rest.join(chosen, "sig").where("group <> p.group").where(
        _fits("size", "p.size", "sig", limit, least))
    return pairs.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))


def _bitmaps(blobs: list[pa.Buffer]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the length of the bitmaps in words, the rows that have it and their bitmaps as a matrix."""
    words = np.array([len(b) // 8 for b in blobs])
    out = {}
    for length in np.unique(words).tolist():
        rows = np.flatnonzero(words == length)
        out[length] = rows, np.frombuffer(b"".join(blobs[r] for r in rows), np.uint64).reshape(
            len(rows), length)
    return out


def _bound(bits: dict[int, tuple[np.ndarray, np.ndarray]], size: np.ndarray, left: np.ndarray,
           right: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row marked ``left`` and one marked ``right`` that sizes and bitmaps allow to be
    similar; of two rows that are both on both sides the one order."""
    for n, (rows, mine) in bits.items():
        here = left[rows]
        rows, mine = rows[here], mine[here]
        for m, (others, theirs) in bits.items():
            if not n <= 2 * m <= 4 * n:  # similar sizes have bitmaps at most twice as long
                continue
            there = right[others]
            others, b, a = others[there], theirs[there], mine
            if not len(a) or not len(b):
                continue
            short = min(n, m)
            if n > m:
                a = np.bitwise_or.reduce(a.reshape(len(a), -1, short), axis=1)
            elif m > n:
                b = np.bitwise_or.reduce(b.reshape(len(b), -1, short), axis=1)
            step = max(1, (1 << 21) // (len(b) * short))
            for begin in range(0, len(rows), step):
                x = rows[begin:begin + step]
                apart = np.bitwise_count(a[begin:begin + step, None, :] ^ b[None, :, :]).sum(
                    axis=2, dtype=np.int32)
                total = size[x, None] + size[None, others]
                ok = apart <= total - 2 * -(-least * total // (100 + least))
                ok &= ~(right[x, None] & left[None, others]) | (x[:, None] < others[None, :])
                i, j = np.nonzero(ok)
                yield x[i], others[j]


def _apart(x: np.ndarray, y: np.ndarray, own: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whether rows ``x`` and ``y`` have no value in common. Row ``own[i]`` of ``n`` has
    ``values[i]``; a value that one row has cannot be common."""
    names, place, times = np.unique(values, return_inverse=True, return_counts=True)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[place]
    own, place = own[keep], number[place[keep]]
    out = np.ones(len(x), bool)
    for low in range(0, int(common.sum()), WIDE * 64):
        here = (place >= low) & (place < low + WIDE * 64)
        wide = -(-min(WIDE * 64, int(common.sum()) - low) // 64)
        bits = np.zeros(n * wide, np.uint64)
        at = place[here] - low
        np.bitwise_or.at(bits, own[here] * wide + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        bits = bits.reshape(n, wide)
        left = np.flatnonzero(out)
        step = (1 << 20) // wide
        for begin in range(0, len(left), step):
            pair = left[begin:begin + step]
            out[pair] = ~(bits[x[pair]] & bits[y[pair]]).any(axis=1)
    return out


def _cells(rest: DataFrame) -> DataFrame:
    """The members of the lists, dealt to cells (sig, x, y) in which about ``BLOCK`` meet as many:
    (sig, x, y, id, size, group, side). Members of different components meet in just one cell of
    a list, on different sides, or on side 2, which is both.

    A component that fills a block has blocks of its own, and those never meet each other; members of
    all others share blocks by their hash. A list of one block is one cell.
    """
    c = F.col
    weight = F.lit(1) + F.floor(c("size") / 1024)
    if rest.groupBy("sig").agg(F.sum(weight).alias("w")).where(c("w") > BLOCK).isEmpty():
        return rest.select("sig", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "id", "size",
                           "group", F.lit(2).alias("side"))
    per = rest.groupBy("sig", "group").agg(F.sum(weight).alias("w"))
    per = per.withColumn("parts", F.when(c("w") >= BLOCK, F.ceil(c("w") / BLOCK)))
    loose = per.groupBy("sig").agg(F.sum("w").alias("all"), F.sum(F.when(c("parts").isNull(), c("w"))).alias("w"))
    loose = loose.where(c("all") > BLOCK).select(
        "sig", F.ceil(F.coalesce("w", F.lit(0)) / BLOCK).alias("parts"))
    owned = per.where("parts is not null").select("sig", "group", "parts")
    long = cut(loose.select("sig", F.lit(None).cast("long").alias("owner"), "parts").where("parts > 0").unionByName(
        owned.withColumnRenamed("group", "owner").join(loose.select("sig"), "sig", "left_semi")), "blocks")
    lists = long.select("sig").distinct()
    once = rest.join(lists, "sig", "left_anti").select(
        "sig", F.lit(0).alias("x"), F.lit(0).alias("y"), "id", "size", "group", F.lit(2).alias("side"))

    # A block is (owner, part); shared ones have no owner.
    own = long.where("owner is not null").select("sig", c("owner").alias("group"), c("parts").alias("own_parts"))
    shared = long.where("owner is null").select("sig", c("parts").alias("shared_parts"))
    named = rest.join(lists, "sig", "left_semi").join(own, ["sig", "group"], "left").join(shared, "sig", "left")
    named = named.select(
        "sig", "id", "size", "group", F.when(c("own_parts").isNotNull(), c("group")).alias("owner"),
        F.pmod(F.xxhash64("id", "sig"), F.coalesce("own_parts", "shared_parts")).cast("int").alias("part"))
    others = long.select("sig", c("owner").alias("to"), F.explode(
        F.expr("sequence(0, cast(parts as int) - 1)")).alias("to_part"))
    mine, to = F.struct("owner", "part"), F.struct(c("to").alias("owner"), c("to_part").alias("part"))
    met = named.join(others, "sig").where("owner is null or to is null or owner <> to")
    block = lambda s: F.xxhash64(s["owner"], F.lit(1), s["part"])
    met = met.select("sig", F.least(mine, to).alias("x"), F.greatest(mine, to).alias("y"), "id", "size", "group",
                     F.when(mine.eqNullSafe(to), 2).when(mine < to, 0).otherwise(1).alias("side"))
    return once.select("sig", c("x").cast("long"), c("y").cast("long"), "id", "size", "group", "side").unionByName(
        met.select("sig", block(c("x")).alias("x"), block(c("y")).alias("y"), "id", "size", "group", "side"))


def _across(rest: DataFrame, classes: DataFrame, limit: int, least: int) -> DataFrame:
    """Pairs across the components of a list, first members left out, whose bitmaps allow the
    similarity. A pair comes from the first list it shares that may give it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            of = [held.column(n).to_numpy() for n in ("sig", "x", "y")]
            change = np.flatnonzero(np.any([v[1:] != v[:-1] for v in of], axis=0)) + 1
            if len(change):
                done, held = held.slice(0, change[-1]), held.slice(change[-1])
                for begin, end in zip([0, *change[:-1]], change, strict=True):
                    yield from one(done.slice(begin, end - begin))
        if held is not None and held.num_rows:
            yield from one(held)

    def one(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        sig = part["sig"][0].as_py()
        ids, group, side = (part[n].to_numpy() for n in ("id", "group", "side"))
        size = part["size"].to_numpy().astype(np.int64)
        left, right = side != 1, side != 0
        # Within a cell of its own the largest component is on one side only: it is not compared with itself.
        names, of, times = np.unique(group, return_inverse=True, return_counts=True)
        if side[0] == 2:
            if len(names) == 1:
                return
            left = of != times.argmax()
        bits = _bitmaps([b.as_buffer() for b in part["bits"].chunk(0)])
        listed = part["sigs"].chunk(0)
        own = np.repeat(np.arange(len(ids)), pc.list_value_length(listed).to_numpy())
        values = listed.flatten().to_numpy()
        # Only lists of the same kind give the pair: one with a heavy set is in no list of subsets,
        # one of light sets comes out of no list of a single shingle.
        before = (values < sig) & ((values ^ sig) & 1 == 0)
        own, values = own[before], values[before]
        pairs = []
        for i, j in _bound(bits, size, left, right, least):
            ok = group[i] != group[j]
            if not sig & 1:
                ok &= np.maximum(size[i], size[j]) > limit
            pairs.append((i[ok], j[ok]))
        if not pairs:
            return
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if len(i):
            first = _apart(i, j, own, values, len(ids))
            x, y = ids[i[first]], ids[j[first]]
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    # A set is in no more lists than its signatures.
    marks = rest.groupBy("id").agg(F.collect_list("sig").alias("sigs")).join(
        classes.select("id", "bits"), "id")
    return _cells(rest).join(marks, "id").repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").select(
        "sig", "x", "y", "id", "size", "group", "side", "sigs", "bits").mapInArrow(run, "a long, b long")


def _plausible(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs whose bitmaps allow the similarity, with both sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_size, b_size = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            total = a_size + b_size
            most = total - 2 * -(-least * total // (100 + least))
            ok = [least_difference(x.as_buffer(), y.as_buffer()) <= m for x, y, m in
                  zip(batch.column(3), batch.column(5), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda side: classes.select(F.col("id").alias(side), F.col("size").alias(f"{side}_size"),
                                     F.col("bits").alias(f"{side}_bits"))
    full = pairs.join(of("a"), "a").join(of("b"), "b")
    return full.select("a", "b", "a_size", "a_bits", "b_size", "b_bits").mapInArrow(
        run, "a long, b long")


def _sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the classes in ``pairs``. A filter says by their keys which texts to take apart."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    low, high = WANTED
    size = min(high, max(low, 1 << (16 * pairs.count()).bit_length()))
    at = F.pmod(F.col("hash"), F.lit(size))
    words = classes.join(ids, "id", "left_semi").groupBy(F.shiftright(at, 5).alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {size}) & 31 as int))")).alias("m")).toArrow()
    bits = np.zeros(size // 32, np.uint32)
    if words.num_rows:
        bits[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    wanted = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            place = batch.column(1).to_numpy() % size
            keep = wanted.value[place >> 5] >> (place & 31).astype(np.uint32) & 1 == 1
            found, held = [], 0
            for _, shingles in shingle_sets(batch.column(0).filter(pa.array(keep)), k):
                own = class_of(shingles)
                if own not in seen:
                    seen.add(own)
                    found.append((own, shingles.tobytes()))
                    held += len(shingles)
                if held > 1 << 19:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in zip(*found, strict=True)], names=["id", "shingles"])
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*found, strict=True)], names=["id", "shingles"])

    kept = docs.select("text", F.xxhash64("key").alias("hash")).mapInArrow(run, "id long, shingles binary")
    return kept.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, least: int) -> DataFrame:
    """The pairs that are similar, counted on whole sets."""
    sets = cut(_sets(docs, pairs, classes, k), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                ok.append(100 * common >= least * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda side: sets.select(F.col("id").alias(side), F.col("shingles").alias(f"{side}_set"))
    full = pairs.join(of("b"), "b").join(of("a"), "a")
    links = cut(full.select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long"), "links")
    drop(sets)
    return links


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE,
         least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Members and links. Members: ``key``, ``class`` and ``n_shingles``, a row per text. Links: the
    classes ``a`` and ``b`` of similar sets; where a chain of links already holds two sets together,
    their own link may be left out."""
    return _joined(docs, key, text, k, least)[:2]


def _joined(docs: DataFrame, key: str, text: str, k: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, links, and the components: each linked class ``id`` with the smallest one, ``group``, that
    links reach from it."""
    c = F.col
    spark = docs.sparkSession
    docs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    measured = cut(_measure(docs, k), "shingles")
    members = cut(measured.where("kind = 0").select("key", c("id").alias("class"), c("size").alias(
        "n_shingles")), "members")
    classes = cut(measured.where("kind = 0 and data is not null").select(
        "id", "size", F.xxhash64("key").alias("hash"), c("data").alias("bits")).dropDuplicates(["id"]), "classes")
    # Sizes up to the largest that is ever tried as a boundary, one ratio, and the number of signatures.
    sizes = {r["size"]: r["n"] for r in classes.where(c("size") < 2 * LARGEST_LIGHT).groupBy(
        "size").agg(F.count("*").alias("n")).collect()}
    some = measured.where("kind = 2").groupBy("id").agg(F.sum("size").alias("n")).groupBy("n").count()
    limit = boundary(sizes, rare_list([(r.n, r["count"]) for r in some.collect()], least), least)
    many = classes.agg(F.sum("size")).first()[0] or 0

    rarity = spark.sparkContext.broadcast(_sketch(measured))
    drop(measured)
    # A position of the filter is free for a signature only if they are few.
    worth = many * (100 - least) // 100 < 2 * SHARED
    repeated = spark.sparkContext.broadcast(_repeated(docs, rarity, limit, k, least)) if worth else None
    lists = cut(_shared(_postings(docs, rarity, repeated, limit, k, least)), "lists")
    for sent in (rarity, repeated):
        if sent is not None:
            sent.destroy()
    tidy(spark)
    starred = lists.where("id <> first").where(_fits("size", "first_size", "sig", limit, least))
    pairs = starred.select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"))

    def linked(pairs: DataFrame, links: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links and their components after those among ``pairs``."""
        near = cut(pairs, "pairs")
        if near.isEmpty():
            return links, groups
        new = _links(docs, near, classes, k, least)
        out = cut(links.union(new), "links"), _grouped(new, groups)
        drop(near, links, new, groups)
        return out

    none = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "id long, group long")
    links, groups = linked(_plausible(pairs.distinct(), classes, least), *none)
    mixed = _mixed(lists, groups)
    links, groups = linked(_plausible(_pivots(mixed, limit, least).distinct(), classes, least), links, groups)
    drop(mixed)
    mixed = _mixed(lists, groups)
    links, groups = linked(_across(mixed, classes, limit, least), links, groups)
    drop(mixed, lists, classes)
    return members.withColumnRenamed("key", key), links, groups


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE,
           least: int = LEAST) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links, per key.

    Rows with a null key follow as they are, with a null component.
    """
    c = F.col
    members, links, grouped = _joined(docs, key, text, k, least)
    drop(links)
    keyed = members.select(c(key).alias("key"), "class", "n_shingles").where("key is not null")
    full = keyed.where("n_shingles > 0")
    joined = grouped.select(c("id").alias("class"), c("group").alias("component"))
    full = full.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    # A key with several texts ties their components together.
    ties = cut(full.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"),
                                       F.collect_set("component").alias("all")).where("a <> b"), "ties")
    if not ties.isEmpty():
        tied = components(ties.select("a", F.explode("all").alias("b"))).select(
            c("id").alias("component"), c("component").alias("tied"))
        full = full.join(tied, "component", "left").withColumn(
            "component", F.coalesce("tied", "component"))
    drop(ties)
    least_key = full.groupBy("component").agg(F.min("key").alias("component_id"))
    out = full.join(least_key, "component").groupBy("key").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    alone = keyed.where("n_shingles = 0").join(out, "key", "left_anti").groupBy("key").agg(
        F.max("n_shingles").alias("n_shingles")).withColumn("component_id", c("key"))
    loose = members.where(c(key).isNull()).select(
        c(key).alias("key"), "n_shingles", c(key).alias("component_id"))
    return out.unionByName(alone).unionByName(loose).withColumnRenamed("key", key)


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of linked documents the one with the smallest
    key, of rows with equal keys one, and all rows with a null key or without words."""
    c = F.col
    lost = groups(docs, key, text).where(c(key) != c("component_id")).select(c(key).alias("lost"))
    rows = docs.select(docs[key].alias("key"), F.struct(*docs.columns).alias("doc"))
    kept = rows.join(lost, c("key") == c("lost"), "left_anti")
    again = kept.groupBy("key").count().where("count > 1 and key is not null").select("key")
    once = kept.join(again, "key", "left_anti")
    several = kept.join(again, "key", "left_semi").dropDuplicates(["key"])
    return once.select("doc.*").unionByName(several.select("doc.*"))
