"""Hard negatives, token counts and conversation repair against plain versions."""

import hashlib
import heapq
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from piitrace.llm import conversation_repair as repair
from piitrace.llm import hard_negatives, queries, token_counts
from piitrace.llm.encode import encoder
from tests.llm.frames import CLASHING, awkward_texts, documents
from tests.oracle_check import compare, connect

DROPPED = public_tokenizers.path("word_bpe_49k.json")
QUICK = settings(max_examples=120, deadline=None, suppress_health_check=list(HealthCheck))
TEXT = st.text(st.one_of(st.sampled_from(" \n\t.,'sStAa1é́ß日Σ\x85\xa0\x1c😀eing"), st.characters(
    exclude_categories=["Cs"])), max_size=40)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_conversation_repair"])
def test_sql_agrees(spark, folder, name):
    ok, text = compare(spark, connect(folder), name, folder, queries.QUERIES, queries.ORACLES)
    assert ok, text


# --- token counts ---------------------------------------------------------------------------

def library():
    tok = Tokenizer.from_file(DROPPED)
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


@QUICK
@given(texts=st.lists(TEXT, min_size=1, max_size=8))
def test_counts_are_those_of_the_library(texts):
    n = library()
    got = encoder(DROPPED, token_counts.Counter).counts(pa.array(texts, pa.string()))
    assert got.tolist() == [n(t) for t in texts]


@QUICK
@given(words=st.lists(st.text("aeinrstohl", min_size=1, max_size=30), min_size=1, max_size=40))
def test_words_walk_side_by_side(words):
    n = library()
    got = encoder(DROPPED, token_counts.Counter).transducer.count([w.encode() for w in words])
    assert got.tolist() == [n(w) for w in words]


def test_all_bytes_at_once():
    """The arrays make room for any number of letters."""
    n = library()
    words = [chr(i) * 3 for i in range(0x4E00, 0x4F00)] + ["é", "a"] + ["ü" * 40]
    counter = token_counts.Counter(DROPPED)
    assert counter.transducer.count([w.encode() for w in ["abc"] * 20]).tolist() == [n("abc")] * 20
    assert counter.transducer.count([w.encode() for w in words]).tolist() == [n(w) for w in words]


def test_transducer_forgets(monkeypatch):
    """Beyond its bound the transducer starts anew, also in the middle of a word."""
    monkeypatch.setattr(token_counts, "STATES", 50)
    n, rng = library(), np.random.default_rng(3)
    counter = token_counts.Counter(DROPPED)
    for _ in range(4):
        words = ["".join(rng.choice(list("abcdefghistn"), rng.integers(1, 400))) for _ in range(20)]
        assert counter.transducer.count([w.encode() for w in words]).tolist() == [n(w) for w in words]
    assert len(counter.transducer._states) < 100_000


@QUICK
@given(text=st.text("ab é\n<|endoftext|>", max_size=60), cuts=st.lists(st.integers(0, 60), max_size=7))
def test_maps_of_slices_compose(text, cuts):
    counter = encoder(DROPPED, token_counts.Counter)
    at = sorted({0, len(text), *(x for x in cuts if x < len(text))})
    slices = [text[a:b] for a, b in itertools.pairwise(at)] or [""]
    assert token_counts.compose(counter, token_counts.slice_maps(counter, slices)) == library()(text)


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SLICE", 1000)
    n = library()
    rows = token_counts.count(documents(spark), DROPPED).collect()
    want = sorted((str(k), len((t or "").encode()), n(t)) for k, t in awkward_texts())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert token_counts.count(documents(spark).limit(0), DROPPED).count() == 0


def test_token_counts_of_the_sample(spark, folder):
    n = library()
    texts = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    rows = queries.op12_token_counts(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.n_bytes) == (n(texts[r.doc_id]), len((texts[r.doc_id] or "").encode()))
        assert r.over_limit == (r.n_tokens > 2048)


# --- hard negatives -------------------------------------------------------------------------

@settings(max_examples=30, deadline=None)
@given(m=st.integers(1, 70), d=st.integers(1, 70), n=st.integers(1, 90), top=st.sampled_from(
    [3, 1 << 20, 1 << 40, 1 << 70]))
def test_products_are_exact(m, d, n, top):
    rng = np.random.default_rng(m * 10_000 + d * 100 + n)
    draw = lambda size: np.array([[int(x) for x in row] for row in (
        rng.uniform(-1, 1, size) * top)], object)
    a, b = draw((m, d)), draw((n, d))
    want = np.clip(a @ b.T, -hard_negatives.LARGEST, hard_negatives.LARGEST).astype(np.int64)
    assert (hard_negatives.products(a, b) == want).all()


def plain_negatives(rows, anchors):
    good = [(k, lab, [int(np.floor(256 * x)) for x in v]) for k, lab, v in rows
            if k is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    for i, (key, lab, v) in enumerate(good):
        if not anchors(key):
            continue
        others = [(dot(v, w), k, lb) for j, (k, lb, w) in enumerate(good) if j != i and len(w) == len(v)]
        for p, pk in sorted(((s, k) for s, k, lb in others if lb == lab), key=lambda x: (-x[0], x[1]))[:5]:
            window = sorted(((s, k) for s, k, lb in others if lb != lab and 80 * p <= 100 * s <= 100 * p),
                            key=lambda x: (-x[0], x[1]))[:5]
            out += [(key, pk, r, k, p, s) for r, (s, k) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile", [7, 4096])
def test_hard_negatives(spark, monkeypatch, tile):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.integers(0, 5, 4) / 4]) for i in range(120)]
    rows += [(20, 1, [1.0, 0.5, 0.0, 1.0]), (130, None, [1.0] * 4), (131, 1, None), (132, 1, [1.0, None, 1.0, 1.0]),
             (133, 2, [float("nan")] * 4), (134, 2, [float("inf")] * 4), (None, 1, [1.0] * 4), (140, 0, []),
             (141, 0, [1.0, 2.0]), (150, 1, [1.0, 2.0]), (160, 2, [0.0] * 4), (170, 0, [-1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    for name in CLASHING + ("anchor", "tile", "dims", "asked"):
        df = df.withColumn(name, F.lit("clash"))
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(tuple(r[x] for x in names) for r in got) == plain_negatives(rows, lambda k: k % 10 == 0)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_large_components(spark):
    rows = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 1.0]), (2, 2, [1e299, 1.0]), (3, 2, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = hard_negatives.mine(df, F.col("vec_id") == 0).collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id, r.positive_score) for r in got] == [
        (0, 1, 2, hard_negatives.LARGEST)]


# --- conversation repair --------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """Cost and first audit in ASCII order by a search over (row, state), smallest (cost, audit) first."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        nxt = 3 if q == 2 else 2
        heapq.heappush(heap, (cost + 2, audit + "I", i, nxt))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q))
            if fault in ("-", "t"):
                more = fault == "t"
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(q)
                if to is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, nxt))
    raise AssertionError


def plain_report(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        of = [r for r in damaged(rows) if r[0] == conv]
        of.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, marked, n = set(), [], dict.fromkeys("xdt", 0)
        for _, _, role, text in of:
            body = text.rstrip(WHITE)
            fault = "x" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"
            seen.add((role, text))
            marked.append((role, fault))
            n[fault] = n.get(fault, 0) + 1
        turns = [r[1] for r in of if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(marked))
        cost, audit = cheapest(marked)
        size, lines, at = len(audit) - audit.count("D"), [], 0
        left = iter(of)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[2:]
            if edit == "D":
                continue
            if edit in "IR":
                role = ("user", "assistant")[(at - size % 2) % 2]
            lines.append(f"{role}:{text}")
            at += 1
        out[conv] = (gaps, n["x"], n["d"], n["t"], illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed=5):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "It goes on", "", "  \n", "Why? ", "ends\x0b", None, "é", "a.b"]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in [*range(1, 60), None, -7]:
        for _ in range(rng.integers(1, 12)):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 14))
            role = roles[rng.choice(7, p=[.36, .36, .1, .06, .04, .04, .04])]
            rows.append((conv, turn, role, texts[rng.integers(len(texts))]))
    return rows + rows[:20]


@pytest.mark.parametrize("piece", [3, 1 << 15])
def test_repair(spark, monkeypatch, piece):
    """Also with conversations cut into many pieces, as hot ones are."""
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    for name in ("conv", "kind", "piece", "n", "audit", "first"):
        df = df.withColumn(name, F.lit("clash"))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = {r.conv_id: tuple(r[x] for x in names) for r in repair.report(df, repair.damage(df)).collect()}
    assert got == plain_report(rows)
    assert repair.report(df.limit(0), df.limit(0)).count() == 0


def test_repaired_rows_are_in_order(spark):
    rows = conversations(6)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = repair.repaired(df, repair.audits(df)).toPandas()
    for _, of in turns.groupby(turns.conv_id.fillna(-1)):
        of = of.sort_values("place")
        assert of.place.tolist() == list(range(len(of)))
        initials = "".join(r[:1] for r in of.role)
        assert initials.removeprefix("s").replace("ua", "") == "" and initials not in ("", "s")


def test_long_runs():
    """A run advances by powers as it does row by row, and unrolls to the cheapest edits."""
    for symbol in "suaoSUAOx":
        after = repair.CLOSE
        for n in range(1, 70):
            after = repair.minplus(repair.power(symbol, 0), after)
            assert (repair.advance(symbol, n, repair.CLOSE) == after).all()
    for text in ["u" * 9, "uuuaaa", "sSuxa", "aaaa", "s", "x" * 30, "oooo", "Uuau" * 5, "sssss"]:
        faults = [("o" if x == "x" else x.lower(), "x" if x == "x" else "t" if x.isupper() else "-") for x in text]
        assert repair.whole(text) == cheapest(faults)[::-1]
    audit, state = repair.unroll([("u", 100_001)], repair.CLOSE, repair.START, True)
    assert state == repair.ASSISTANT and len(audit.replace("I", "")) == 100_001
