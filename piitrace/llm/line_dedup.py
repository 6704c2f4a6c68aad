"""Deletion of repeated runs of lines, found by winnowing over line hashes.

A gram is the shortest run of lines from a line on that has ``NOISE`` words; its number is made
of the hashes of its lines. In every run of lines that just reaches ``SURE`` words the gram with
the smallest number is a fingerprint. Two runs that agree in ``SURE`` words or more therefore
share a fingerprint, while most grams need not leave their task.

Places with equal fingerprints meet their first place, in the order of key, row and line. Both
documents' hashes are compared along that offset, so a match grows both ways as far as the
lines agree; agreeing runs of ``NOISE`` words or more are deleted from the later place. A first
place may agree with less of a run than another does, so the search is repeated on what is
left, with deleted lines as breaks, until nothing is found: then no run of ``SURE`` words that
stands anywhere before is left, and each deleted line has an equal one that stays.

Lines are equal if they are after lower-casing A-Z; empty lines do not count and stay.

Defined results: null and empty texts stay as they are; of repeated rows the first keeps its lines
(rows are numbered by their place in the input); null keys come first; lines of any length are whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piitrace.llm.words import LINES, UNSPACED, _power, mix, scan
from piitrace.session import cut, drop

#: Fewest words of a run that is deleted, and words from which a repeated run is always found.
NOISE, SURE = 25, 50


def line_table(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the hashes and word counts of its lines that are not empty."""
    for (_, n, of, number, start, _), (_, _, w_of, _, w_start, _) in zip(
            scan(texts, LINES), scan(texts, UNSPACED), strict=True):
        span = 1 + int(max(start.max(initial=0), w_start.max(initial=0)))
        line = np.searchsorted(of * span + start, w_of * span + w_start, "right") - 1
        words = np.bincount(line, minlength=len(of)).astype(np.int32)
        edge = np.searchsorted(of, np.arange(n + 1))
        for i in range(n):
            yield number[edge[i]:edge[i + 1]], words[edge[i]:edge[i + 1]]


def fingerprints(hashes: np.ndarray, words: np.ndarray, alive: np.ndarray, noise: int = NOISE,
                 sure: int = SURE) -> tuple[list[int], list[int]]:
    """Chosen grams of a text and the lines at which they begin."""
    grams: list[int] = []
    places: list[int] = []
    if int(words[alive].sum()) < sure:
        return grams, places
    edges = np.flatnonzero(np.diff(np.concatenate([[0], alive.view(np.int8), [0]])))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        count = np.concatenate([[0], np.cumsum(words[begin:end])])
        n = end - begin
        if count[-1] < sure:
            continue
        short = np.searchsorted(count, count[:-1] + noise)  # the line behind each gram
        long = np.searchsorted(count, count[:-1] + sure)
        whole = int(np.searchsorted(short, n, "right"))
        up, down = _power(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes[begin:end] * up[:n], out=total[1:])
        stop = short[:whole]
        number = mix((total[stop] - total[:whole]) * down[:whole]
                     + mix((stop - np.arange(whole)).astype(np.uint64))).view(np.int64).tolist()
        last = np.searchsorted(short, long, "right").tolist()  # grams within the run from i on
        chosen, at = -1, 0
        for i in range(int(np.searchsorted(long, n, "right"))):
            if chosen < i:  # it lies before the run: look at the whole run anew
                chosen, at = i, i + 1
            for j in range(at, last[i]):
                if number[j] <= number[chosen]:
                    chosen = j
            at = max(at, last[i])
            if not places or places[-1] != begin + chosen:
                grams.append(number[chosen])
                places.append(begin + chosen)
    return grams, places


def agreeing(a: np.ndarray, a_alive: np.ndarray, b: np.ndarray, b_alive: np.ndarray, words: np.ndarray,
             shift: int, noise: int = NOISE) -> list[tuple[int, int]]:
    """Runs of lines of ``b``, each equal to the line of ``a`` that stands ``shift`` before it."""
    begin, end = max(0, shift), min(len(b), len(a) + shift)
    if begin >= end:
        return []
    here = slice(begin, end)
    there = slice(begin - shift, end - shift)
    same = (b[here] == a[there]) & b_alive[here] & a_alive[there]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]]))) + begin
    return [(x, y) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
            if words[x:y].sum() >= noise]


def _arrays(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    return (np.frombuffer(row[f"{side}hashes"].as_buffer(), np.uint64),
            np.frombuffer(row[f"{side}alive"].as_buffer(), np.bool_))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = batch.columns
    for i in range(batch.num_rows):
        yield {n: col[i] for n, col in zip(batch.schema.names, columns, strict=True)}


def _lines(docs: DataFrame) -> DataFrame:
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(h.tobytes(), w.tobytes(), np.ones(len(h), bool).tobytes())
                   for h, w in line_table(batch.column(2))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))],
                    names=["row", "key", "hashes", "words", "alive"])

    return docs.mapInArrow(run, f"row long, key {kind}, hashes binary, words binary, alive binary")


def _fingerprints(lines: DataFrame, noise: int, sure: int) -> DataFrame:
    kind = lines.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, places, times = [], [], []
            for row in _rows(batch):
                hashes, alive = _arrays(row)
                words = np.frombuffer(row["words"].as_buffer(), np.int32)
                g, p = fingerprints(hashes, words, alive, noise, sure)
                grams += g
                places += p
                times.append(len(g))
            at = pa.array(np.repeat(np.arange(batch.num_rows), times))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.int64()), batch.column(1).take(at), batch.column(0).take(at),
                 pa.array(places, pa.int64())], names=["gram", "key", "row", "place"])

    return lines.select("row", "key", "hashes", "words", "alive").mapInArrow(
        run, f"gram long, key {kind}, row long, place long")


def _repeats(lines: DataFrame, noise: int, sure: int) -> DataFrame:
    """The runs to delete now: (row, begin, end), numbered among the lines that are not empty."""
    c = F.col
    found = cut(_fingerprints(lines, noise, sure), "fingerprints")
    first = found.groupBy("gram").agg(F.min(F.struct("key", "row", "place")).alias("first"),
                                      F.count("*").alias("n")).where("n > 1").select("gram", "first")
    # Sort-merge joins: what is shuffled follows the input, also where a small side would be broadcast.
    pairs = found.join(first.hint("merge"), "gram").where("row <> first.row or place <> first.place").select(
        "row", c("first.row").alias("a"), (c("place") - c("first.place")).alias("shift")).distinct()
    earlier = lines.select(c("row").alias("a"), c("hashes").alias("a_hashes"), c("alive").alias("a_alive"))
    full = pairs.hint("merge").join(lines.select("row", "hashes", "words", "alive"), "row").hint("merge").join(earlier, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in _rows(batch):
                a, a_alive = _arrays(row, "a_")
                b, b_alive = _arrays(row)
                words = np.frombuffer(row["words"].as_buffer(), np.int32)
                out += [(row["row"].as_py(), x, y) for x, y in
                        agreeing(a, a_alive, b, b_alive, words, row["shift"].as_py(), noise)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)],
                                                 names=["row", "begin", "end"])

    runs = cut(full.select("row", "shift", "hashes", "words", "alive", "a_hashes", "a_alive").mapInArrow(
        run, "row long, begin long, end long"), "runs")
    drop(found)
    return runs


def _deleted(lines: DataFrame, runs: DataFrame) -> DataFrame:
    kind = lines.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in _rows(batch):
                alive = np.frombuffer(row["alive"].as_buffer(), np.bool_).copy()
                for r in row["runs"].as_py() or []:
                    alive[r["begin"]:r["end"]] = False
                out.append(alive.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())],
                                             names=["row", "key", "hashes", "words", "alive"])

    # A document's runs lie within its lines; equal ones are merged before they are listed.
    listed = runs.distinct().groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    return lines.join(listed.hint("merge"), "row", "left").select(
        "row", "key", "hashes", "words", "alive", "runs").mapInArrow(
        run, f"row long, key {kind}, hashes binary, words binary, alive binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, sure: int = SURE
          ) -> DataFrame:
    """``docs`` with the text less its later repeated runs, ``n_lines`` (not empty, before) and
    ``n_removed``. Columns of these two names are replaced.

    Until the result has been written, a copy of the rows and what is left of their lines stay in the
    shared folder; what the rounds wrote is gone."""
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    # Written once: a second reading of the input might number its rows in another way.
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("row"),
                               F.struct(*names).alias("doc")), "documents")
    lines = cut(_lines(numbered.select("row", F.col("doc")[key].alias("key"),
                                       F.col("doc")[text].alias("text"))), "lines")
    while True:
        runs = _repeats(lines, noise, sure)
        if runs.isEmpty():
            break
        before, lines = lines, cut(_deleted(lines, runs), "lines")
        drop(before, runs)
    alive = cut(lines.select("row", "alive"), "alive")
    drop(lines, runs)

    schema = docs.schema.add("n_lines", "long").add("n_removed", "long")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, count, gone = [], [], []
            # Only texts that lose lines are taken apart.
            for value, blob in zip(batch.column(0).field(at), batch.column(1), strict=True):
                alive = np.frombuffer(blob.as_buffer(), np.bool_)
                lost = len(alive) - int(alive.sum())
                count.append(len(alive))
                gone.append(lost)
                value = value.as_py()
                if lost:
                    flags = iter(alive.tolist())
                    value = "\n".join(x for x in value.split("\n") if not x or next(flags))
                texts.append(value)
            docs_in = batch.column(0)
            columns = docs_in.flatten()
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(count, pa.int64()), pa.array(gone, pa.int64())],
                schema=pa.schema([*docs_in.type, pa.field("n_lines", pa.int64()), pa.field("n_removed", pa.int64())]))

    return numbered.select("row", "doc").join(alive.hint("merge"), "row").select(
        "doc", "alive").mapInArrow(run, schema)
