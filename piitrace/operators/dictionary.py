"""Masking texts by a dictionary of known values that does not come with the rows.

A dictionary within ``automaton_values`` and ``automaton_bytes`` goes to every task once, as one
Aho-Corasick automaton a worker: a text is read once, however many values there are. A larger one
stays distributed. Each value is found by one of its n-grams, the one that the fewest values have;
a filter of fixed size drops the n-grams of texts that anchor nothing, the rest is joined, and
what was met is verified. No value meets a text that does not hold its anchor.

Both ways find the values that occur in a text and replace them one after the other, the longest
first, equal lengths in the order of the values, by ``[TYPE]``.

Defined results: a null text stays null; null and empty values mask nothing; a value with several
types counts for the smallest; an empty dictionary leaves texts as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values and bytes up to which a dictionary is sent to every task.
AUTOMATON_VALUES, AUTOMATON_BYTES = 500_000, 32 << 20
#: Letters of an anchoring n-gram; a shorter value is its own.
GRAM = 5
#: Positions of the filter of anchors, a power of two.
POSITIONS = 1 << 23
#: Letters of a text that are looked at together.
STRETCH = 1 << 18

_automata: dict[str, object] = {}


def known_values(values: DataFrame) -> DataFrame:
    """One row per value that can mask something: ``value`` and its type."""
    return values.where("value is not null and value <> '' and pii_type is not null").groupBy("value").agg(
        F.min("pii_type").alias("pii_type"))


def _automaton(name: str, entries: list[tuple[str, str]]):
    """The worker's automaton of a dictionary; it keeps the last one."""
    made = _automata.get(name)
    if made is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for value, kind in entries:
            made.add_word(value, (value, f"[{kind.upper()}]"))
        made.make_automaton()
        _automata.clear()
        _automata[name] = made
    return made


def _replaced(text: str | None, found: dict[str, str]) -> str | None:
    for value in sorted(found, key=lambda v: (-len(v), v)):
        text = text.replace(value, found[value])
    return text


def _by_automaton(df: DataFrame, values: DataFrame, text_col: str) -> DataFrame:
    rows = values.select("value", "pii_type").toArrow()
    if not rows.num_rows:
        return df.withColumn("masked", F.col(text_col))
    name = uuid.uuid4().hex
    sent = df.sparkSession.sparkContext.broadcast(
        list(zip(rows["value"].to_pylist(), rows["pii_type"].to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, sent.value)
        for batch in batches:
            masked = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = {v: put for _, (v, put) in automaton.iter(text)} if text else None
                masked.append(_replaced(text, found) if found else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(masked, pa.string())],
                                             names=batch.schema.names)

    chosen = df.select(F.struct(*df.columns).alias("row"), df[text_col].alias("masked"))
    out = chosen.mapInArrow(run, chosen.schema)
    return out.select("row.*", "masked")


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _places(letters: np.ndarray, n: int) -> np.ndarray:
    """The filter's position of each n-gram."""
    size = len(letters) - n + 1
    h = np.zeros(size, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + letters[j:j + size]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(29)) & np.uint64(POSITIONS - 1)


def _anchor_grams(text: str, sizes: list[int], bits: np.ndarray) -> set[str]:
    """The distinct n-grams of a text that the filter knows, in one pass a size."""
    out = set()
    for begin in range(0, len(text), STRETCH):
        part = text[begin:begin + STRETCH + GRAM - 1]
        letters = _letters(part)
        for n in sizes:
            if len(part) >= n:
                at = _places(letters, n)
                known = bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)
                out.update(part[i:i + n] for i in np.flatnonzero(known).tolist())
    return out


def anchors(values: DataFrame) -> DataFrame:
    """``value``, ``pii_type`` and ``gram``: the n-gram of the value that the fewest values have."""
    c = F.col
    size = F.least(F.length("value"), F.lit(GRAM))
    grams = values.select("value", "pii_type", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("value") - size + 1),
        lambda i: F.substring(c("value"), i, size)))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return grams.join(common, "gram").groupBy("value", "pii_type").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def _by_anchors(df: DataFrame, values: DataFrame, text_col: str, row_id: str) -> DataFrame:
    """The same by joins. ``row_id`` tells the rows apart."""
    c = F.col
    anchored = anchors(values)
    sizes = [r.n for r in values.select(F.least(F.length("value"), F.lit(GRAM)).alias("n")).distinct().collect()]
    if not sizes:
        return df.withColumn("masked", c(text_col))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [int(_places(_letters(gram), len(gram))[0]) for gram in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["at"])

    words = anchored.select("gram").distinct().mapInArrow(placed, "at long").groupBy(
        F.shiftright("at", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("m")).toArrow()
    bits = np.zeros(POSITIONS // 32, np.uint32)
    bits[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, times = [], []
            for text in batch.column(1).to_pylist():
                own = _anchor_grams(text, sizes, sent.value) if text else ()
                grams += own
                times.append(len(own))
            at = pa.array(np.repeat(np.arange(batch.num_rows), times))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(grams, pa.string())],
                                             names=["row", "gram"])

    texts = df.select(c(row_id).alias("row"), c(text_col).alias("text"))
    kind = df.schema[row_id].dataType.simpleString()
    met = texts.mapInArrow(kept, f"row {kind}, gram string")
    pairs = met.join(anchored, "gram").select("row", "value", "pii_type")
    listed = pairs.join(texts, "row").where(F.contains(c("text"), c("value"))).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(
            (-F.length("value")).alias("n"), c("value").alias("v"),
            F.concat(F.lit("["), F.upper("pii_type"), F.lit("]")).alias("t")))).alias("known"))
    listed = listed.withColumnRenamed("row", "_row")
    masked = F.aggregate("known", c(text_col), lambda acc, r: F.replace(acc, r["v"], r["t"]))
    joined = df.join(listed, df[row_id] == c("_row"), "left")
    return joined.select(*df.columns, F.coalesce(masked, c(text_col)).alias("masked"))


def mask_dictionary(df: DataFrame, values: DataFrame, row_id: str, text_col: str = "line",
                    automaton_values: int = AUTOMATON_VALUES, automaton_bytes: int = AUTOMATON_BYTES
                    ) -> DataFrame:
    """``df`` with ``masked``: its text without any value of ``values`` (pii_type, value).

    ``row_id`` names a column without nulls that tells the rows apart; a dictionary beyond the bounds
    joins on it.
    """
    values = known_values(values)
    size = values.agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes")).first()
    if size.n <= automaton_values and (size.bytes or 0) <= automaton_bytes:
        return _by_automaton(df, values, text_col)
    return _by_anchors(df, values, text_col, row_id)
