"""Order-preserving packing of token ids into sequences of a fixed capacity.

The texts of an input partition form one token stream in table order. A dynamic
programme chooses the window cuts: a window costs its padding, and a cut costs nothing
at the end of a document, a little at the end of a sentence and more elsewhere. The
cheapest start of the window that ends at a boundary is the minimum of
``cost + position`` over the boundaries within one capacity, which a monotone queue
yields in constant time. The stream is solved in blocks; what a block leaves over
is handed on to the next, so only the end of a partition leaves a remainder. That
is cut into powers of two, lengths that need no padding.

No shuffle: a task reads, encodes and packs its own split, whatever the table's size.

Defined results: null and empty texts are documents of the end id alone; repeated rows and
equal or null ids are documents of their own; a document longer than the capacity goes
over several sequences; an empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from piitrace.llm.encode import encoder

#: Ids gathered before the cuts of a block are chosen.
BLOCK = 1 << 18
#: Without any boundary for so many ids, cuts are allowed at this distance.
RUN = 128
#: Cost of a cut, in padding ids: at the end of a sentence, and elsewhere.
SENTENCE_CUT, INNER_CUT = 8, 64

SCHEMA = ("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")


def boundaries(total: int, ends: np.ndarray, sentences: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions where a cut is allowed, from 0 to ``total``, and what a cut costs there."""
    cost = np.full(total + 1, -1, np.int64)
    cost[sentences] = SENTENCE_CUT
    cost[ends] = 0
    cost[0] = cost[total] = 0
    at = np.flatnonzero(cost >= 0)
    more = (np.diff(at) - 1) // RUN
    if more.any():
        first = np.repeat(at[:-1], more)
        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        cost[first + step * RUN] = INNER_CUT
        at = np.flatnonzero(cost >= 0)
    return at.tolist(), cost[at].tolist()


def choose_cuts(at: list[int], cost: list[int], capacity: int) -> list[int]:
    """Window cuts, from 0 to a boundary less than one capacity before the last, with the
    smallest sum of padding and cut costs; what follows the last cut is left over.

    Consecutive boundaries lie at most ``capacity`` apart. Among equal costs the window
    that begins earliest is taken, and the least is left over.
    """
    best, back = [0], [0]
    queue: deque[tuple[int, int]] = deque()
    for j in range(1, len(at)):
        value = best[j - 1] + at[j - 1]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, j - 1))
        low = at[j] - capacity
        while at[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best.append(value + capacity - at[j] + cost[j])
        back.append(i)
    j = min((i for i in range(len(at)) if at[i] > at[-1] - capacity), key=lambda i: (best[i], -i))
    out = []
    while j:
        out.append(at[j])
        j = back[j]
    return [0, *reversed(out)]


def powers(length: int) -> list[int]:
    """``length`` as a falling sum of powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Stream:
    """The pieces of one partition's documents."""

    def __init__(self, first_sequence: int, capacity: int, sentence_end: np.ndarray):
        self.sequence, self.capacity, self.sentence_end = first_sequence, capacity, sentence_end
        self.parts: list[tuple[object, int, int, np.ndarray]] = []  # key, start, document's ids, ids
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.parts.append((key, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= max(BLOCK, 8 * self.capacity):
            yield from self.flush(last=False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.parts:
            return
        ids = np.concatenate([p[3] for p in self.parts])
        ends = np.cumsum([len(p[3]) for p in self.parts])
        sentences = np.flatnonzero(self.sentence_end[ids]) + 1
        cuts = choose_cuts(*boundaries(len(ids), ends, sentences), self.capacity)
        if last:
            for size in powers(len(ids) - cuts[-1]):
                cuts.append(cuts[-1] + size)
        parts, self.parts, begin, w = self.parts, [], 0, 0
        for (key, start, whole, own), end in zip(parts, ends.tolist(), strict=True):
            at = begin
            while at < end and w + 1 < len(cuts):
                to = min(end, cuts[w + 1])
                yield (key, start + at - begin, to - at, own[at - begin:to - begin].tobytes(), whole,
                       self.sequence + w, at - cuts[w], cuts[w + 1] - cuts[w])
                at = to
                if at == cuts[w + 1]:
                    w += 1
            if at < end:
                self.parts.append((key, start + at - begin, whole, own[at - begin:]))
            begin = end
        self.sequence += w
        self.held = sum(len(p[3]) for p in self.parts)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
         capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row per piece of a document: ``key``, ``start`` (ids of the document before it),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (with the end id),
    ``sequence_id``, ``offset`` in the sequence and ``sequence_length`` before padding."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        marks = np.zeros(1 + max([*enc.vocabulary.values(), *enc.special.values(), end_id]), bool)
        for name, i in enc.vocabulary.items():
            marks[i] = name.removesuffix("</w>").endswith((".", "!", "?"))
        stream = Stream(TaskContext.get().partitionId() << 33, capacity, marks)
        close = np.array([end_id], "<u4")
        rows: list[tuple] = []
        names = None
        for batch in batches:
            names = names or [pa.field("key", batch.schema.field(0).type), *(
                pa.field(n, pa.binary() if n == "ids" else pa.int64())
                for n in (c.split()[0] for c in SCHEMA.split(", ")))]
            keys = batch.column(0).to_pylist()
            for k, ids in zip(keys, enc.batch(batch.column(1)), strict=True):
                rows.extend(stream.add(k, np.concatenate([ids, close])))
                if len(rows) > 4000:
                    yield _table(rows, names)
                    rows = []
        rows.extend(stream.flush(last=True))
        if rows:
            yield _table(rows, names)
        enc.forget()  # a worker may go on with tasks of another kind

    out = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(
        run, f"key {kind.simpleString()}, {SCHEMA}")
    return out.withColumnRenamed("key", key)


def _table(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))
