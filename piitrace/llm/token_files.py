"""Token ids in binary segments: a concatenated id array with Elias-Fano document ends.

A segment is one blob of some hundred thousand ids of consecutive documents:

    magic  b"TIDS"      version  u2        bytes per id  u2
    documents n  u8     ids m  u8          low bits l  u8
    low parts           n * l bits, little-endian bit order, padded to 8 bytes
    high parts          unary: bit (end >> l) + i is set for document i; (m >> l) + n bits, padded
    samples             u4 position of every 256th set bit of the high parts
    ids                 m unsigned numbers of 2 or 4 bytes

The end of document i is ``(select(i) - i) << l | low(i)``; ``select`` starts at a sample and
counts set bits of at most a few words, for all documents that are read at once. It takes about ``2 + log2(m / n)`` bits a document.

A store is a Parquet table of segments, which Spark's committer writes, so that lost
tasks leave nothing behind and any file system will do. Segments carry ``part`` (the range
partition), ``segment`` (its place there), the keys of their documents and the ids before
them in the partition; the ids before each partition are in a table of one row per
partition beside them.

Defined results: null and empty texts hold the end id alone; rows with equal keys follow each
other in the order of their texts, null keys come first; an empty table gives an empty store.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piitrace.llm.encode import encoder

#: Ids after which a segment ends; a longer document makes a longer segment.
SEGMENT = 1 << 18
#: Set bits between two samples of the select structure.
SAMPLE = 256
_HEAD = struct.Struct("<4sHHQQQ")


class EliasFano:
    """Rising numbers below or equal to ``top``, in few bits, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((v[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(),
                          bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((top >> low_bits) + n + 1, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, _padded(low), _padded(np.packbits(bits, bitorder="little")),
                   at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """Position of the i-th set bit of the high parts."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        words = self.high.view("<u8")
        w = at >> 6
        word = int(words[w]) >> (at & 63) << (at & 63)
        while (count := word.bit_count()) <= left:
            left -= count
            w += 1
            word = int(words[w])
        for _ in range(left):
            word &= word - 1
        return (w << 6) + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit, low = i * self.low_bits, 0
        for k in range(self.low_bits):
            low |= (int(self.low[(bit + k) >> 3]) >> ((bit + k) & 7) & 1) << k
        return (self.select(i) - i) << self.low_bits | low

    def take(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``, by a select each."""
        words = self.high.view("<u8")
        at = self.samples[i // SAMPLE].astype(np.int64)
        w, left = at >> 6, i % SAMPLE
        off = (at & 63).astype(np.uint64)
        word = words[w] >> off << off
        count = np.bitwise_count(word).astype(np.int64)
        far = np.flatnonzero(count <= left)
        while len(far):
            left[far] -= count[far]
            w[far] += 1
            word[far] = words[w[far]]
            count[far] = np.bitwise_count(word[far])
            far = far[count[far] <= left[far]]
        # The word's set bits before the wanted one go by halves.
        place = np.zeros(len(i), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            less = np.bitwise_count(word >> place.astype(np.uint64) & np.uint64((1 << half) - 1)).astype(np.int64)
            up = less <= left
            left -= np.where(up, less, 0)
            place += np.where(up, half, 0)
        bit, low = i * self.low_bits, np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            low |= (self.low[bit + k >> 3].astype(np.int64) >> (bit + k & 7) & 1) << k
        return ((w << 6) + place - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every number, decoded at once."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits]
        low = bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))
        return (at - np.arange(self.n) << self.low_bits) | low


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(-len(data) % 8, np.uint8)])


def write_segment(documents: list[np.ndarray], width: int) -> bytes:
    """The blob of a segment; ``width`` bytes hold an id."""
    ids = np.concatenate(documents) if documents else np.zeros(0, "<u4")
    ends = EliasFano.build(np.cumsum([len(d) for d in documents]), len(ids))
    head = _HEAD.pack(b"TIDS", 1, width, ends.n, len(ids), ends.low_bits)
    return b"".join([head, ends.low.tobytes(), ends.high.tobytes(), ends.samples.tobytes(),
                     ids.astype(f"<u{width}").tobytes()])


def read_segment(blob: bytes) -> tuple[EliasFano, np.ndarray]:
    """Document ends and ids of a segment."""
    magic, version, width, n, m, low_bits = _HEAD.unpack_from(blob)
    if magic != b"TIDS" or version != 1:
        raise ValueError("not a token segment")
    at = _HEAD.size
    sizes = (-(-n * low_bits // 64) * 8, -(-((m >> low_bits) + n + 1) // 64) * 8,
             -(-n // SAMPLE) * 4)
    parts = []
    for size in sizes:
        parts.append(np.frombuffer(blob, np.uint8, size, at))
        at += size
    return (EliasFano(n, low_bits, parts[0], parts[1], parts[2].view("<u4")),
            np.frombuffer(blob, f"<u{width}", m, at))


def document(segment: tuple[EliasFano, np.ndarray], i: int) -> np.ndarray:
    """The ids of document i of a segment, by two selects."""
    ends, ids = segment
    return ids[ends[i - 1] if i else 0:ends[i]]


def bounds(ends: EliasFano) -> np.ndarray:
    """Where each document of a segment begins, and the end of the last."""
    return np.concatenate([[0], ends.take(np.arange(ends.n))])


def write(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text",
          end_id: int = 2) -> None:
    """Write the ids of all texts in rising key order to a store at ``path``."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        top = max([*enc.vocabulary.values(), *enc.special.values(), end_id])
        width = 2 if top < 1 << 16 else 4
        part = TaskContext.get().partitionId()
        close = np.array([end_id], "<u4")
        keys, held, size, segment, before, of = [], [], 0, 0, 0, None

        def row() -> pa.RecordBatch:
            fields = [("part", pa.int64()), ("segment", pa.int64()), ("before", pa.int64()),
                      ("n_ids", pa.int64()), ("keys", pa.list_(of)), ("data", pa.binary())]
            values = [part, segment, before, size, keys, write_segment(held, width)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, (_, t) in zip(values, fields, strict=True)],
                schema=pa.schema(fields))

        for batch in batches:
            of = batch.schema.field(0).type
            for k, ids in zip(batch.column(0).to_pylist(), enc.batch(batch.column(1)), strict=True):
                keys.append(k)
                held.append(np.concatenate([ids, close]))
                size += len(ids) + 1
                if size >= SEGMENT:
                    yield row()
                    keys, held, before, size, segment = [], [], before + size, 0, segment + 1
        if held:
            yield row()

    chosen = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    parts = max(chosen.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = chosen.repartitionByRange(parts, "key", F.xxhash64("text")).sortWithinPartitions(
        "key", "text")
    ordered.mapInArrow(
        run, f"part long, segment long, before long, n_ids long, keys array<{kind}>, data binary"
    ).write.parquet(f"{path}/segments")
    # One number per partition passes the driver: as many as the write had tasks.
    sizes = spark.read.parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    total, rows = 0, []
    for part, n in sorted((r.part, r.n) for r in sizes.collect()):
        rows.append((part, total))
        total += n
    spark.createDataFrame(rows, "part long, part_start long").write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """One row per document of a store: ``key``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    segments = spark.read.parquet(f"{path}/segments")
    kind = segments.schema["keys"].dataType.elementType
    starts = spark.read.parquet(f"{path}/parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, keys, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                ends, ids = read_segment(blob.as_buffer())
                begin = bounds(ends)
                wide = ids.astype("<u4")
                buffers = [None, pa.py_buffer((begin * 4).astype("<i4").tobytes()),
                           pa.py_buffer(wide.tobytes())]
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(begin[:-1] + first.as_py()), pa.array(np.diff(begin)),
                     pa.Array.from_buffers(pa.binary(), len(begin) - 1, buffers)],
                    names=["key", "start", "n_tokens", "ids"])

    placed = segments.join(F.broadcast(starts), "part").select(
        (F.col("part_start") + F.col("before")).alias("first"), "keys", "data")
    out = placed.mapInArrow(
        run, f"key {kind.simpleString()}, start long, n_tokens long, ids binary")
    return out.withColumnRenamed("key", key)
