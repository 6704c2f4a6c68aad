"""The pipeline's stages one after the other, each against a plain version of its rule."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.frames import documents
from tests.llm.test_texts import copied_lines, near_copies, plain_groups, repeated_runs


def corpus():
    rows = [(1000 + (k or 500), t) for k, t in copied_lines()] + near_copies(seed=11)
    rows += [(1, None), (2, ""), (3, "?! 12 ..."), (4, "plain words of a clean text that nobody copied"),
             (None, "a clean text without an id, which stays as it is")]
    return [(k, t, "en") for k, t in rows]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "line_dedup", "near_copies", "packing"]


def test_each_stage(spark):
    (_, language), (_, lines), (_, copies), (_, packing) = corpus_pipeline.STAGES
    docs = documents(spark, corpus())
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    before = pairs(docs)

    told = language(spark, docs, "")
    assert told.columns == docs.columns
    kept = pairs(told)
    assert kept == [r for r in before if any(ch.isalpha() for ch in r[1] or "")]

    single = lines(spark, told, "").cache()
    assert single.columns == docs.columns
    rest = pairs(single)
    ordered = [t for _, t in sorted(rest, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert repeated_runs(ordered) == 0 and all(t.strip() for _, t in rest)
    untouched = dict(kept)
    assert (4, untouched[4]) in rest and (None, untouched[None]) in rest
    assert {x for _, t in kept for x in t.lower().split("\n")} == {
        x for _, t in rest for x in t.lower().split("\n")}

    alone = copies(spark, single, "")
    assert alone.columns == docs.columns
    groups = plain_groups([(k, t) for k, t in rest if k is not None])
    want = sorted({k for k, _, low in groups if k == low})
    got = pairs(alone)
    assert sorted(k for k, _ in got if k is not None) == want
    assert sum(k is None for k, _ in got) == 1 and set(got) <= set(rest)

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing(spark, alone, "").collect()
    for key, text in got:
        own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == key)
        ids = np.concatenate([np.frombuffer(b, "<u4") for _, b in own])
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids + [2]


def test_empty_table(spark):
    docs = documents(spark, corpus()).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run_is_registered(spark, folder):
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    out = entry.queries()["pipeline"](spark, folder)
    pieces = out.select("doc_id", "start", "length", "doc_tokens").collect()
    whole = {}
    for p in pieces:
        whole.setdefault(p.doc_id, [0, p.doc_tokens])[0] += p.length
    assert whole and all(a == b for a, b in whole.values())


def test_columns_come_back(spark):
    """Whatever a user's columns are called, the stages that filter leave them alone."""
    docs = documents(spark, corpus())
    for name in ("Score", "own_Score", "n_removed", "hash", "lost", "doc", "key"):
        docs = docs.withColumn(name, of_its_own(name))
    rows = lambda df: {tuple(str(r[c]) for c in df.columns if c != "text") for r in df.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert 0 < len(rows(after)) and rows(after) <= rows(docs)


def of_its_own(name):
    """A value of its own for each row and column."""
    return F.concat_ws("-", F.lit(name), F.crc32(F.coalesce("text", F.lit("none")).cast("binary")))
