"""Language identification with bit-sliced Bloom filters of letter n-grams.

The filters of all languages share their positions: a position holds one mask with a bit
per language, so that ``and`` over the positions of an n-gram gives every language that has
it at once. A text's score for a language is the share of its n-grams whose mask holds the
language, corrected for the chance that all positions of a foreign n-gram are set. The
largest corrected share decides; ties go to the language that sorts first.

Letters are lower-cased, anything else is a gap, runs of gaps count as one, and an n-gram
is four places of which the second is a letter, so word starts and ends take part.

Fitting reads labelled texts chosen by a hash of their key, about ``SAMPLE`` per language
and whole; an n-gram enters a language's filter if at least ``LEAST`` of its sampled texts, and
two or more, have it. Filter positions and languages bound what reaches the driver.

Defined results: a text that is null or has no letter is ``und`` with score 0; a text with letters
none of whose n-grams is known gets the language with most labelled texts, with score 0; without
any labelled text all are ``und``; null labels are not learnt; repeated rows and null or equal
keys are texts of their own; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piitrace.session import cut

#: Labelled texts per language that fitting reads, about.
SAMPLE = 1500
#: Share of a language's sampled texts that must have an n-gram.
LEAST = 0.004
#: Positions of the filters, a power of two, and positions per n-gram.
POSITIONS, PROBES = 1 << 20, 3
#: Languages per mask.
WORD = 62
#: Texts handled at a time.
ROWS = 500
#: Letters handled at a time.
SLICE = 1 << 19

#: Odd multipliers of the position hashes.
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93],
                np.uint64)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool,
                                    sys.maxunicode + 1))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of the texts as 64-bit numbers, the text of each, and which texts have letters."""
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(low)), size)
    codes = np.where(letters()[codes], codes, 0).astype(np.uint64)
    lettered = np.bincount(of[codes > 0], minlength=len(low)) > 0
    # A gap before and three after each text keep n-grams within it.
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0) | (of[1:] != of[:-1])
    codes, of = codes[keep], of[keep]
    size = np.bincount(of, minlength=len(low))
    at = np.arange(len(codes)) + 4 * of + 1
    spread = np.zeros(len(codes) + 4 * len(low), np.uint64)
    spread[at] = codes
    middle = at[codes > 0]
    value = spread[middle - 1]
    for step in range(3):
        value = value << np.uint64(21) ^ value >> np.uint64(43) ^ spread[middle + step] * _ODD[3]
    return value, of[codes > 0], lettered


def positions(values: np.ndarray, probe: int, bits: int) -> np.ndarray:
    mixed = (values ^ values >> np.uint64(29)) * _ODD[probe]
    return ((mixed ^ mixed >> np.uint64(32)) * _ODD[(probe + 1) % 3]) >> np.uint64(64 - bits)


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with about ``SLICE`` letters; a longer text is a run of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, texts[begin:]


@dataclass
class Model:
    """Languages in order, the most frequent one, the masks and each language's chance of a
    false answer."""

    languages: list[str]
    usual: int
    masks: np.ndarray
    chance: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        bits = int(self.masks.shape[1]).bit_length() - 1
        for begin, part in _slices([t or "" for t in texts]):
            values, of, lettered = grams(part)
            n = np.bincount(of, minlength=len(part))
            at = [positions(values, p, bits) for p in range(PROBES)]
            share = np.zeros((len(self.languages), len(part)))
            for w, row in enumerate(self.masks):
                found = row[at[0]] & row[at[1]] & row[at[2]]
                for bit, lang in enumerate(range(w * WORD, min(len(share), (w + 1) * WORD))):
                    share[lang] = np.bincount(of, found >> np.uint64(bit) & np.uint64(1), len(part))
            if not len(share):
                names += ["und"] * len(part)
                continue
            share /= np.maximum(n, 1)
            share = np.maximum(0, share - self.chance[:, None]) / (1 - self.chance[:, None])
            best = np.where(share.max(0) > 0, share.argmax(0), self.usual)
            names += [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
            scores[begin:begin + len(part)] = np.where(lettered, share.max(0), 0)
        return names, np.clip(scores, 0, 1)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        sample: int = SAMPLE) -> Model:
    """Fit on the rows of ``docs``, all of them labelled by ``lang`` or not used."""
    c = F.col
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"),
                       docs[lang].alias("lang")).where("lang is not null and text is not null")
    # As many rows as there are languages.
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    bits = POSITIONS.bit_length() - 1
    masks = np.zeros((-(-len(languages) // WORD), POSITIONS), np.uint64)
    if not languages:
        return Model([], 0, masks, np.zeros(0))
    spark = docs.sparkSession
    spread = 1 << 40
    shares = spark.createDataFrame(
        [(name, i, min(spread, spread * sample // n)) for i, (name, n) in
         enumerate(sorted(counts.items()))], "lang string, number long, share long")
    chosen = rows.join(F.broadcast(shares), "lang").where(
        F.pmod(F.xxhash64("key", "text"), F.lit(spread)) < c("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(1).to_numpy()
            for begin, part in _slices(batch.column(0).to_pylist()):
                values, of, _ = grams(part)
                pair = np.unique(np.rec.fromarrays([of, values], names="of,value"))
                own = np.rec.fromarrays([number[begin + pair["of"]], pair["value"]], names="n,v")
                own, times = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own["n"].astype(np.int64)), pa.array(own["v"].view(np.int64)),
                     pa.array(times), pa.array(np.zeros(len(own), np.int64))],
                    names=["number", "gram", "texts", "sampled"])
            there, times = np.unique(number, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(there), pa.array(np.zeros(len(there), np.int64)),
                 pa.array(np.zeros(len(there), np.int64)), pa.array(times)],
                names=["number", "gram", "texts", "sampled"])

    seen = cut(chosen.select("text", "number").mapInArrow(
        run, "number long, gram long, texts long, sampled long").groupBy("number", "gram").agg(
        F.sum("texts").alias("texts"), F.sum("sampled").alias("sampled")), "lang-grams")
    sampled = {r.number: r.n for r in
               seen.groupBy("number").agg(F.sum("sampled").alias("n")).collect()}
    least = spark.createDataFrame(
        [(i, max(2.0, LEAST * n) if n > 3 else 1.0) for i, n in sampled.items()],
        "number long, least double")
    kept = seen.join(F.broadcast(least), "number").where("texts >= least").groupBy(
        "gram", F.floor(c("number") / WORD).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(number % {WORD} as int))")).alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([positions(values, p, bits) for p in range(PROBES)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int64)), pa.concat_arrays([batch.column(1)] * PROBES),
                 pa.concat_arrays([batch.column(2)] * PROBES)], names=["at", "word", "mask"])

    # No more rows than the filters have positions.
    table = kept.select("gram", "word", "mask").mapInArrow(
        place, "at long, word long, mask long").groupBy("at", "word").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    masks[table["word"].to_numpy(), table["at"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    filled = [(masks[i // WORD] >> np.uint64(i % WORD) & np.uint64(1)).mean()
              for i in range(len(languages))]
    usual = languages.index(max(languages, key=lambda name: counts[name]))
    return Model(languages, usual, masks, np.array(filled) ** PROBES)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the text alone.

    Columns of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = docs.schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            texts = pc.cast(batch.column(at), pa.string())
            for begin in range(0, len(texts), ROWS):  # few texts as Python strings at a time
                told = shared.value.predict(texts.slice(begin, ROWS).to_pylist())
                names += told[0]
                scores += told[1].tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                schema=batch.schema.append(pa.field("lang_pred", pa.string())).append(
                    pa.field("score", pa.float64())))

    out = type(schema)([*schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(run, out)
