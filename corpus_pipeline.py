"""The corpus pipeline: language, repeated lines, near duplicates, packing.

Every stage takes what the one before kept, and all but the last return the columns of
``documents``, whatever their names: an operator's own columns never replace a user's. ``run`` writes
each stage's rows to the shared folder, drops what the stages before wrote there, and goes on from
there, as a driver of the stages does.

Every stage of an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piitrace.llm import jaccard_join, langid, line_dedup, packing
from piitrace.session import cut, drop, recorded, tidy

#: Least share of a text's n-grams that some language knows.
LEAST_SCORE = 0.05


def _spared(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns of these names out of an operator's way, and how to get all columns back."""
    taken, spare = {n.lower() for n in (*docs.columns, *names)}, {}
    for own in docs.columns:
        if own.lower() in names:
            free = f"own_{own}"
            while free.lower() in taken:
                free = f"own_{free}"
            taken.add(free.lower())
            spare[own] = free
    back = [F.col(f"`{spare.get(n, n)}`").alias(n) for n in docs.columns]
    return docs.withColumnsRenamed(spare), back


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose n-grams no learnt language knows.

    Null and empty texts have no letters and go; very long ones are looked at whole; repeated rows and
    rows with null or equal ids are judged each by its text; columns with any names come back as they
    were. Without any labelled text nothing is known, and nothing is dropped.
    """
    tidy(spark)
    model = langid.fit(docs)
    if not model.languages:
        return docs
    spared, back = _spared(docs, ("lang_pred", "score"))
    told = langid.identify(spared, model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*back)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a text of which nothing is left goes.

    Null and empty texts lose nothing and stay; of repeated rows the first keeps its lines, null ids
    coming first; ``n_chars``, if there is such a column, counts what is left; all other columns, with any
    names, come back as they were.
    """
    tidy(spark)
    spared, back = _spared(docs, ("n_lines", "n_removed"))
    out = line_dedup.dedup(spared)
    gone = (F.col("n_removed") > 0) & (F.trim("text", F.lit(" \t\n\x0b\f\r")) == "")
    out = out.where(~F.coalesce(gone, F.lit(False))).select(*back)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id.

    Rows with a null id stay, as do null and empty texts; of rows with equal ids one stays, whichever;
    columns with any names come back as they were.
    """
    tidy(spark)
    return jaccard_join.one_of_each_group(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 ids.

    Null and empty texts are documents of the end id alone; repeated rows and null or equal ids are
    documents of their own; a text longer than a sequence goes over several. Other columns are not read.
    """
    tidy(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("packing", packed),
]
#: SQL cannot state the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            after = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(docs, *(table for table in made if table is not after))
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
