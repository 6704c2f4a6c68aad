"""Small tables with every awkward row, and plain versions of the word rules."""

import re

from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UNSPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Names that operators use inside.
CLASHING = ("key", "row", "ids", "vec", "size", "class", "gram", "words", "score", "lang_pred",
            "n_lines", "__alive", "component", "sequence_id")


def awkward_texts() -> list[tuple]:
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog. It barks."),
        (2, None),
        (3, ""),
        (4, "   \n\t  "),
        (5, "x" * 20_000),
        (6, long),
        (7, "The quick brown fox jumps over the lazy dog. It barks."),
        (8, "ÀÉ Σας ß 日本語 😀  two  spaces\r\n\x85 \xa0end<|endoftext|>  tail 12345"),
        (9, "Repeated row"),
        (9, "Repeated row"),
        (None, "A text without a key"),
        (-5, "a"),
        (1 << 40, "!!! ??? ..."),
    ]


def documents(spark, rows=None, clash=True):
    """``doc_id``, ``text``, ``lang`` and, if asked for, columns with the operators' own names."""
    rows = awkward_texts() if rows is None else rows
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en") for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for name in CLASHING if clash else ():
        df = df.withColumn(name, F.lit("clash"))
    return df


def words(text, pattern=UNSPACED):
    return pattern.findall((text or "").translate(LOWER))
