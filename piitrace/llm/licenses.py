"""License notices in texts, found by votes of word k-grams on offset diagonals.

All rolling k-grams of the texts meet the k-grams of the templates in a Spark join. A
match at word p of a text and word q of a template votes for the diagonal p - q; a notice
that stands in the text unchanged votes for one diagonal, and inserted or missing words
shift the rest of it to a neighbouring one. Diagonals no further apart than ``GAP`` are
merged into a span, which is accepted if it covers enough of the template's words and is
not much longer than what it covers. The template table is fixed and small, so it is
broadcast; only matches are shuffled.

Base phrases, places where their words stand consecutively, are counted beside that.
Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, numbered from 0.

Defined results: null and empty texts have no words and no labels; repeated rows and null or
equal keys are texts of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piitrace.llm.words import ALPHANUMERIC, scan, windows

#: Words of a k-gram.
K = 4
#: Largest distance between neighbouring diagonals of one span.
GAP = 3
#: Least share of a template's words that a span covers, and of a span's words that are covered.
COVER, DENSE = 0.6, 0.5
#: Most k-grams of templates that are sent to every task.
SENT = 1 << 20

#: Phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notices as their licenses word them, and their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy "
               "of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under "
               "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
               "ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of "
            "the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or "
            "neighboring rights to this work"),
]


def _words(text: str) -> tuple[np.ndarray, np.ndarray]:
    for _, _, of, number, _, _ in scan(pa.array([text]), ALPHANUMERIC):
        return number, of
    return np.zeros(0, np.uint64), np.zeros(0, np.int64)


def scan_words(docs: DataFrame, key: str, text: str, k: int, phrases: dict[str, str]) -> DataFrame:
    """Per text: a row number, ``key``, ``n_words``, base counts, base labels and all k-grams."""
    kind = docs.schema[key].dataType.simpleString()
    sought = [(_words(p)[0], label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, n, of, number, _, _ in scan(batch.column(2), ALPHANUMERIC):
                first_word = np.searchsorted(of, np.arange(n + 1))
                places, labels = [], np.zeros((len(sought), n), bool)
                for row, (phrase, _) in enumerate(sought):
                    m = max(0, len(number) - len(phrase) + 1)
                    hit = np.ones(m, bool)
                    for j, w in enumerate(phrase):
                        hit &= number[j:j + m] == w
                    at = np.flatnonzero(hit)
                    at = at[of[at] == of[at + len(phrase) - 1]]
                    places.append(at)
                    labels[row, of[at]] = True
                at = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
                base = np.bincount(of[at], minlength=n)
                low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(low, of[at], at - first_word[of[at]])
                np.maximum.at(high, of[at], at - first_word[of[at]])
                grams, where = windows(number, of, k)
                bounds = np.searchsorted(of[where], np.arange(n + 1))
                names = [[sought[r][1] for r in np.flatnonzero(labels[:, i])] for i in range(n)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, n), batch.column(1).slice(begin, n),
                    pa.array(np.diff(first_word)), pa.array(base),
                    pa.array(low, mask=base == 0), pa.array(high, mask=base == 0),
                    pa.array(names, pa.list_(pa.string())),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                             pa.array(grams.view(np.int64))),
                ], names=["row", "key", "n_words", "n_base", "first_word", "last_word", "base", "grams"])

    return docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"),
                       docs[text].alias("text")).mapInArrow(
        run, f"row long, key {kind}, n_words long, n_base long, first_word long, last_word long, "
             "base array<string>, grams array<long>")


def template_grams(docs: DataFrame, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """All k-grams of the templates; up to ``SENT`` of them are sent to every task."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words, of = _words(text)
        grams, at = windows(words, of, k)
        rows += [(int(g), number, int(q), label, len(words))
                 for g, q in zip(grams.view(np.int64), at, strict=True)]
    table = docs.sparkSession.createDataFrame(
        rows, "gram long, template int, place int, label string, template_words int")
    return F.broadcast(table) if len(rows) <= SENT else table


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K,
         templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None
         ) -> DataFrame:
    """Per text: ``key``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base`` (labels of
    base phrases) and ``spans``, an array of (label, first, last, coverage): the accepted notices
    from their first word to the one behind the last."""
    c = F.col
    per_text = ["row", "key", "n_words", "n_base", "first_word", "last_word", "base"]
    texts = scan_words(docs, key, text, k, PHRASES if phrases is None else phrases)
    table = template_grams(docs, TEMPLATES if templates is None else templates, k)
    info = F.struct(*per_text[1:]).alias("info")
    votes = (
        texts.select("row", info, F.posexplode_outer("grams").alias("pos", "gram"))
        .join(table, "gram", "left")
        # The first row stays, so that texts without a match keep theirs.
        .where("template is not null or coalesce(pos, 0) = 0")
        .groupBy("row", "info", "template", "label", "template_words",
                 (c("pos") - c("place")).alias("diagonal"))
        .agg(F.min("pos").alias("first"), (F.max("pos") + k).alias("last"),
             F.collect_list("place").alias("places"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = c("diagonal") - F.lag("diagonal").over(order) > GAP
    spans = (
        votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(order))
        .groupBy("row", "info", "template", "label", "template_words", "span")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"),
             F.flatten(F.collect_list("places")).alias("places"))
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform(
            "places", lambda q: F.sequence(q, q + (k - 1)))))))
        .withColumn("coverage", c("covered") / c("template_words"))
    )
    good = (c("template").isNotNull() & (c("coverage") >= COVER)
            & (c("covered") >= DENSE * (c("last") - c("first"))))
    found = F.when(good, F.struct("label", c("first").cast("long").alias("first"),
                                  c("last").cast("long").alias("last"), "coverage"))
    return spans.groupBy("row", "info").agg(
        F.sort_array(F.collect_list(found)).alias("spans")).select(
        c("info.key").alias(key), *(f"info.{n}" for n in per_text[2:]), "spans")
