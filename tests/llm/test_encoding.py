"""Encoders, packing and token stores against the tokenizers library."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from piitrace.llm import bpe_trie, packing, token_counts, token_files
from piitrace.llm.encode import Encoder, encoder
from tests.llm.frames import awkward_texts, documents

SPACED = public_tokenizers.path("byte_bpe_50k.json")
DROPPED = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.one_of(st.sampled_from(" \n\t.,'sStAa1é́ß日Σ\x85\xa0\x1c😀"), st.characters(
    exclude_categories=["Cs"])), max_size=40)
QUICK = settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))


def library(path):
    tok = Tokenizer.from_file(path)
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "kind"), [(SPACED, Encoder), (DROPPED, Encoder),
                                            (SPACED, bpe_trie.TrieEncoder)])
@QUICK
@given(texts=st.lists(TEXT, min_size=1, max_size=8))
def test_ids_are_those_of_the_library(path, kind, texts):
    ids = library(path)
    got = [x.tolist() for x in encoder(path, kind).batch(pa.array(texts, pa.string()))]
    assert got == [ids(t) for t in texts]


@pytest.mark.parametrize(("path", "kind"), [(SPACED, Encoder), (DROPPED, Encoder),
                                            (SPACED, bpe_trie.TrieEncoder)])
def test_letters_that_only_the_library_knows(path, kind):
    """Letters of scripts that are newer than Python's tables, assigned and not."""
    ids = library(path)
    new = [0x1E5D0, 0x10D50, 0x10D70, 0x16D40, 0x105C0, 0x323B0, 0x378, 0x10FFFD]
    texts = [f"{a}{chr(x)}{b}" for x in new for a in ("", ":", "a ", " é<|endoftext|>") for b in ("", "s 7", "\u0301")]
    assert [x.tolist() for x in encoder(path, kind).batch(pa.array(texts))] == [ids(t) for t in texts]
    if path == DROPPED:
        got = encoder(path, token_counts.Counter).counts(pa.array(texts))
        assert got.tolist() == [len(ids(t)) for t in texts]


@pytest.mark.parametrize("path", [SPACED, DROPPED])
def test_plain_words_need_no_pattern(path, monkeypatch):
    """Words of any script, with marks behind them and between line breaks, are told without a regular expression."""
    gap = " " if path == SPACED else "\n"
    text = "Größe, ÉTÉ!! señor### 日本 Über." + gap + "Ça... naïve ΑΣ the"
    enc = Encoder(path)

    def never(chunk):
        raise AssertionError(chunk)

    monkeypatch.setattr(enc, "_split", never)
    monkeypatch.setattr(enc, "_unassigned", never)
    assert [x.tolist() for x in enc.batch(pa.array([text]))] == [library(path)(text)]


def test_printable_letters_are_assigned():
    known = "".join(filter(str.isprintable, map(chr, range(0x110000))))
    assert Encoder(DROPPED)._unassigned(known) is None


@pytest.mark.parametrize("path", [SPACED, DROPPED])
def test_ids_do_not_depend_on_texts_before(path):
    """Strings that are a word in one text and something else in the next, in both orders, apart and together."""
    ids = library(path)
    texts = ["\u0307\u0331", "\u0130\u0331", "x\n\u0307\u0331\x85y", "<|ENDOFTEXT|>", "<|endoftext|>",
             "a <|EndOfText|>\t<|endoftext|> b", "\x0b\x0c\r\u2003\x1c'S\n'll", "", " ", "\n \n"]
    for some in (texts, texts[::-1]):
        enc = Encoder(path)
        apart = [next(enc.batch(pa.array([t]))).tolist() for t in some]
        again = [x.tolist() for x in enc.batch(pa.array(some))]
        together = [x.tolist() for x in Encoder(path).batch(pa.array(some))]
        assert apart == again == together == [ids(t) for t in some]


def test_words_of_merge_traps():
    texts = ["a" * n for n in range(1, 60)] + ["0" * 37, "=" * 81, "=-" * 20, " " * 9, "ÃÂ" * 7,
                                              "<|endoftext|>", "x <|endoftext|>  y", "abcabcab" * 9]
    ids = library(SPACED)
    enc = encoder(SPACED, bpe_trie.TrieEncoder)
    for text, got in zip(texts, enc.batch(pa.array(texts)), strict=True):
        assert got.tolist() == ids(text)
        assert enc.decode(got.tolist()) == text


def test_trie_rows(spark):
    ids = library(SPACED)
    df = documents(spark)
    back = bpe_trie.decode(bpe_trie.encode(df, SPACED), SPACED).collect()
    want = sorted((str(k), ids(t), t or "") for k, t in awkward_texts())
    assert sorted((str(r.doc_id), list(r.ids), r.decoded) for r in back) == want
    assert bpe_trie.encode(df.limit(0), SPACED).count() == 0


def all_cuts(at, cost, capacity):
    """The least cost over every choice of cuts, with what each leaves over."""
    best = None
    inner = range(1, len(at))
    for n in range(len(at)):
        for chosen in itertools.combinations(inner, n):
            places = [0, *(at[i] for i in chosen)]
            gaps = np.diff(places)
            if (gaps > capacity).any() or at[-1] - places[-1] >= capacity:
                continue
            value = sum(capacity - g for g in gaps) + sum(cost[i] for i in chosen)
            best = value if best is None else min(best, value)
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=9))
def test_cuts_are_the_cheapest(steps):
    at = [0, *np.cumsum([s for s, _ in steps]).tolist()]
    cost = [0, *(c for _, c in steps)]
    cuts = packing.choose_cuts(at, cost, 10)
    value = sum(10 - g for g in np.diff(cuts)) + sum(cost[at.index(p)] for p in cuts[1:])
    assert (np.diff(cuts) <= 10).all() and at[-1] - cuts[-1] < 10
    assert value == all_cuts(at, cost, 10)


def test_pieces_hold_every_id_once(spark):
    ids = library(DROPPED)
    rows = packing.pack(documents(spark), DROPPED, capacity=256).toPandas()
    want = sorted((str(k), ids(t) + [2]) for k, t in awkward_texts())
    got = []
    for _, doc in rows.groupby([rows.doc_id.fillna(-1), "sequence_id", "offset"]):
        assert len(doc) == 1
    for r in rows.itertuples():
        assert len(r.ids) == 4 * r.length and r.offset + r.length <= r.sequence_length <= 256
    for key, of in rows.groupby(rows.doc_id.fillna(-1)):
        of = of.sort_values(["start", "sequence_id"])
        whole = np.concatenate([np.frombuffer(b, "<u4") for b in of.ids])
        got.append((key, len(whole), of.doc_tokens.iloc[0]))
    assert sum(n for _, n, _ in got) == sum(len(w) for _, w in want)
    by = dict(((k if k != "None" else "-1"), w) for k, w in want)
    for key, n, _ in got:
        times = 2 if key == 9 else 1
        assert n == times * len(by[str(int(key))])
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq.offset == seq.length.cumsum() - seq.length).all()
        assert seq.length.sum() == seq.sequence_length.iloc[0]
    padded = sum(256 - n for n in rows.groupby("sequence_id").length.sum() if n & (n - 1))
    assert padded < 0.05 * rows.length.sum()
    assert packing.pack(documents(spark).limit(0), DROPPED).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=700))
def test_elias_fano_round_trip(sizes):
    ends = np.cumsum(sizes).astype(np.int64)
    top = int(ends[-1]) if len(ends) else 0
    ef = token_files.EliasFano.build(ends, top)
    assert [ef[i] for i in range(len(sizes))] == ends.tolist() == ef.all().tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 9000)), min_size=1, max_size=700), st.integers(0, 99))
def test_selects_at_once(sizes, seed):
    ends = np.cumsum(sizes).astype(np.int64)
    ef = token_files.EliasFano.build(ends, int(ends[-1]))
    assert ef.take(np.arange(len(ends))).tolist() == ends.tolist()
    some = np.random.default_rng(seed).integers(0, len(ends), 20)
    assert ef.take(some).tolist() == ends[some].tolist()


def test_reading_selects(monkeypatch):
    """A segment is read by selects, not by unpacking all its bits."""
    monkeypatch.delattr(token_files.EliasFano, "all")
    docs = [np.arange(n, dtype="<u4") % 50_257 for n in [0, 1, 70_000, 3, 0] * 120]
    ends, _ = token_files.read_segment(token_files.write_segment(docs, 2))
    assert token_files.bounds(ends).tolist() == np.cumsum([0, *map(len, docs)]).tolist()


def test_segment_round_trip():
    docs = [np.arange(n, dtype="<u4") % 50_257 for n in (0, 1, 70_000, 3, 0)]
    for width in (2, 4):
        segment = token_files.read_segment(token_files.write_segment(docs, width))
        for i, d in enumerate(docs):
            assert token_files.document(segment, i).tolist() == d.tolist()


def test_store(spark, tmp_path):
    ids = library(SPACED)
    token_files.write(documents(spark), str(tmp_path / "a"), SPACED)
    rows = token_files.read(spark, str(tmp_path / "a")).collect()
    order = sorted(awkward_texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    got = sorted(rows, key=lambda r: r.start)
    for r, (key, text) in zip(got, order, strict=True):
        want = np.array(ids(text) + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (key, at, len(want), want.tobytes())
        at += len(want)
    token_files.write(documents(spark).limit(0), str(tmp_path / "b"), SPACED)
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_queries_on_the_sample(spark, folder):
    from piitrace.llm import queries

    texts = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    spaced, dropped = library(SPACED), library(DROPPED)
    seen = {}
    for r in queries.op1_pack(spark, folder).collect():
        own = np.array(dropped(texts[r.doc_id]) + [2], "<u4")
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {k: len(dropped(t)) + 1 for k, t in texts.items()}
    rows = queries.op3_bpe_trie(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = spaced(texts[r.doc_id])
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    at = 0
    for r in sorted(queries.op7_token_files(spark, folder).collect()):
        own = np.array(spaced(texts[r.doc_id]) + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)
