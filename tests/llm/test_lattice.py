"""The lattice of a batch against word-by-word recursions, and whole scores against enumeration."""

import math

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from piitrace.llm import lattice_lm
from tests.llm.frames import documents, words

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.one_of(st.sampled_from("aeinrsthlo\x00"), st.characters(exclude_categories=["Cs"])),
                        min_size=1, max_size=60), min_size=1, max_size=30, unique=True))
def test_all_words_at_once(texts):
    pieces = lattice_lm.pieces_of(MODEL)
    logp = pieces.ranked
    got = lattice_lm.word_logs_of(pieces, logp, texts)
    assert np.allclose(got, lattice_lm.word_logs(pieces, logp.tolist(), texts), rtol=1e-12)
    counts = lattice_lm.expected_counts_of(pieces, logp, texts)
    assert np.allclose(counts, lattice_lm.expected_counts(pieces, logp.tolist(), texts), rtol=1e-9, atol=1e-12)


def segmentations(pieces, word):
    """Every way to write a word: tuples of the pieces used, letters without a piece as their bytes."""
    if not word:
        yield ()
        return
    for n in range(1, len(word) + 1):
        i = pieces.ids.get(word[:n])
        if i is not None:
            yield from ((i, *rest) for rest in segmentations(pieces, word[n:]))
    if pieces.ids.get(word[0]) is None:
        spelt = tuple(pieces.bytes[b] for b in word[0].encode())
        yield from ((*spelt, *rest) for rest in segmentations(pieces, word[1:]))


def plain_scores(rows, train):
    """log10 probability of each text by listing all segmentations of every word."""
    pieces = lattice_lm.pieces_of(MODEL)
    learnt = [w for (k, t), use in zip(rows, train, strict=True) if use for w in words(t)]
    ends = sum(train)
    ways = {w: list(segmentations(pieces, "▁" + w)) for w in {w for _, t in rows for w in words(t)}}
    p = np.exp(pieces.ranked)
    for _ in range(lattice_lm.ROUNDS):
        total = np.where(np.isfinite(pieces.ranked), lattice_lm.SMOOTH, 0.0)
        for w in set(learnt):
            mass = np.array([math.prod(p[i] for i in s) for s in ways[w]])
            for s, m in zip(ways[w], mass / mass.sum(), strict=True):
                for i in s:
                    total[i] += m
        p = total / total.sum()
    n = len(learnt)
    new = max(sum(learnt.count(w) == 1 for w in set(learnt)), 1) / n
    out = []
    for _, t in rows:
        value = math.log10(ends / (n + ends))
        for w in words(t):
            spelt = sum(math.prod(p[i] for i in s) for s in ways[w])
            value += math.log10((n / (n + ends)) * (new * spelt + (1 - new) * learnt.count(w) / n))
        out.append(value)
    return out


def test_scores_against_all_segmentations(spark):
    rows = [(1, "the cat sat on the mat"), (2, "THE dog sat\n on a log"), (3, ""), (4, None), (5, "cat é日 zq"),
            (6, "the the the mat"), (7, "a\tdog's day?")]
    train = [True, True, True, False, False, True, False]
    df = documents(spark, rows).withColumn("key2", lattice_lm.F.col("doc_id"))
    df = df.withColumn("use", df.doc_id.isin([k for (k, _), use in zip(rows, train, strict=True) if use]))
    got = {r.doc_id: r.score for r in lattice_lm.score(df, MODEL, "use").collect()}
    for (key, _), want in zip(rows, plain_scores(rows, train), strict=True):
        assert got[key] == pytest.approx(want, rel=1e-9)
