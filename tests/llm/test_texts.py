"""Language, likelihood, licenses, lines and shingle joins against plain versions."""

import collections
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piitrace.llm import jaccard_join, langid, lattice_lm, licenses, line_dedup
from piitrace.llm import words as W
from tests.llm.frames import ALPHANUMERIC, UNSPACED, awkward_texts, documents, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbB é\n\t.1\x0b\x1c日"), max_size=14), max_size=6))
def test_word_numbers(texts):
    for table, pattern in ((W.UNSPACED, UNSPACED), (W.ALPHANUMERIC, ALPHANUMERIC)):
        got = [[] for _ in texts]
        names = {}
        for begin, _, of, number, start, stop in W.scan(pa.array(texts, pa.string()), table):
            for i, n, a, b in zip(of.tolist(), number.tolist(), start, stop, strict=True):
                got[begin + i].append(texts[begin + i].encode()[a:b].decode().lower())
                assert names.setdefault(got[begin + i][-1], n) == n
        assert got == [[w.lower() for w in words(t, pattern)] for t in texts]
        assert len(set(names.values())) == len(names)


# Language ------------------------------------------------------------------------------------

LANGS = {"en": "the house and the garden of my neighbour are green when it rains",
         "de": "das haus und der garten meines nachbarn sind grün wenn es regnet",
         "fr": "la maison et le jardin de mon voisin sont verts quand il pleut"}


def labelled(n=40):
    rng = np.random.default_rng(3)
    rows, key = [], 0
    for lang, text in LANGS.items():
        for _ in range(n):
            own = text.split()
            rows.append((key, " ".join(rng.choice(own, 25)), lang))
            key += 1
    return rows


def test_language(spark):
    train = documents(spark, labelled() + [(900, "zzz", None), (901, None, "en")], clash=False)
    model = langid.fit(train)
    assert model.languages == ["de", "en", "fr"]
    asked = [(i, t, None) for i, t in enumerate(LANGS.values())] + [
        (10, None, None), (11, "", None), (12, "12 ?! \n", None), (13, "日本語", None),
        (14, "Garten " * 40_000, None), (14, "Garten", None), (None, "the neighbour", None)]
    told = langid.identify(documents(spark, asked), model)
    assert told.columns.count("score") == 1
    rows = [(r.doc_id, r.lang_pred, r.score) for r in told.collect()]
    by = {k: (lang, s) for k, lang, s in rows if k not in (14, None)}
    assert [by[i][0] for i in range(3)] == list(LANGS)
    assert all(by[i] == ("und", 0.0) for i in (10, 11, 12))
    assert by[13] == ("en", 0.0) or by[13][0] in LANGS
    assert [lang for k, lang, _ in rows if k == 14] == ["de", "de"]
    assert [lang for k, lang, _ in rows if k is None] == ["en"]
    assert all(0 <= s <= 1 for _, _, s in rows)
    nothing = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify(train, nothing).collect()} == {"und"}
    assert langid.identify(train.limit(0), model).count() == 0


def test_masks_hold_every_kept_gram(spark):
    model = langid.fit(documents(spark, labelled(), clash=False))
    names, scores = model.predict(list(LANGS.values()))
    assert names == list(LANGS) and (scores > 0.9).all()


def test_language_on_held_out_documents(spark, folder):
    from piitrace.llm import queries

    truth = {r.doc_id: r.lang for r in queries.table(spark, folder, "documents").collect()}
    rows = queries.op4_language(spark, folder).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(rows) == len(truth) and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95


# Likelihood ----------------------------------------------------------------------------------


def segmentations(pieces, logp, word):
    """The log of the summed probability of every way to cut a word into pieces."""
    word, total = "▁" + word, 0.0
    for cuts in itertools.product([False, True], repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        value = 0.0
        for a, b in zip(at[:-1], at[1:], strict=True):
            part = word[a:b]
            if part in pieces.ids:
                value += logp[pieces.ids[part]]
            elif len(part) == 1:
                value += sum(logp[pieces.bytes[x]] for x in part.encode())
            else:
                value = -math.inf
                break
        total += math.exp(value)
    return math.log(total)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("thein日ß~"), min_size=1, max_size=8), min_size=1, max_size=6))
def test_marginals_are_sums_over_segmentations(some):
    pieces = lattice_lm.pieces_of(PIECES)
    logp = pieces.ranked.tolist()
    for word, got in zip(some, lattice_lm.word_logs(pieces, logp, some), strict=True):
        assert got == pytest.approx(segmentations(pieces, logp, word), abs=1e-9)
    # Expected uses spell each word exactly once.
    uses = lattice_lm.expected_counts(pieces, logp, some)
    size = {i: len(p) for p, i in pieces.ids.items()} | dict.fromkeys(pieces.bytes, 0)
    spelt = sum(u * size[i] for i, u in enumerate(uses) if u)
    odd = sum(c not in pieces.ids for w in some for c in w)
    assert spelt == pytest.approx(sum(len(w) + 1 for w in some) - odd)


@pytest.mark.parametrize("head", [4, 1 << 18])
def test_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lattice_lm, "HEAD", head)
    df = documents(spark).withColumn("train", F.when(F.col("doc_id") == 7, None).otherwise(
        F.col("doc_id") != 8))
    rows = lattice_lm.score(df, PIECES, "train").collect()
    texts = awkward_texts()
    seen = collections.Counter()
    for key, text in texts:
        if key not in (7, 8, None):
            seen.update([*words(text), None])
    n, v = sum(seen.values()), len(seen)
    want = sorted((str(k), len(words(t)) + 1, sum(w in seen for w in [*words(t), None]), n,
                   round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6))
                  for k, t in texts)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                 for r in rows)
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    same = {round(r.score, 9) for r in rows if r.doc_id in (1, 7)}
    assert len(same) == 1
    assert lattice_lm.score(df.limit(0), PIECES, "train").count() == 0


def test_nothing_to_learn_from(spark):
    df = documents(spark, [(1, "some words"), (2, None)], clash=False).withColumn("train", F.lit(False))
    rows = {r.doc_id: r for r in lattice_lm.score(df, PIECES, "train").collect()}
    assert rows[2].score == pytest.approx(math.log10(0.5)) and rows[1].score < rows[2].score
    assert rows[1].base_score == 0.0 and rows[1].n_known == 0


# Licenses ------------------------------------------------------------------------------------


def test_licenses(spark):
    apache = licenses.TEMPLATES[2][1]
    bent = apache.replace("software distributed", "all of the software distributed").replace("ANY KIND", "KIND")
    rows = awkward_texts() + [
        (20, f"intro words here {bent} and more text"), (21, "All  rights-reserved. CC BY, cc by"),
        (22, "the general public, license of the general public license"), (23, "Released under the MIT License."),
        (24, "released under the sea"), (25, "all rights")]
    got = collections.defaultdict(list)
    for r in licenses.find(documents(spark, rows)).collect():
        got[r.doc_id].append(r)
    for key, text in rows:
        own = words(text, ALPHANUMERIC)
        places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(own))
                  if own[i:i + len(phrase.split())] == phrase.split()]
        for r in got[key]:
            assert (r.n_words, r.n_base) == (len(own), len(places))
            assert (r.first_word, r.last_word) == (
                (min(places)[0], max(places)[0]) if places else (None, None))
            assert sorted(r.base) == sorted({label for _, label in places})
            for s in r.spans:
                assert 0 <= s.first < s.last <= len(own) and 0 < s.coverage <= 1
    assert [s.label for s in got[20][0].spans] == ["apache"] and got[20][0].spans[0].coverage > 0.8
    assert got[20][0].spans[0].first == 3
    assert [s.label for s in got[23][0].spans] == ["mit"]
    assert not got[24][0].spans and not got[25][0].spans and len(got[9]) == 2
    assert licenses.find(documents(spark, rows).limit(0)).count() == 0


# Lines ---------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 40), st.booleans()), max_size=30))
def test_every_sure_run_has_a_fingerprint(lines):
    hashes = np.array([h * 7919 + 1 for h, _, _ in lines], np.uint64)
    count = np.array([w for _, w, _ in lines], np.int32)
    alive = np.array([a or w > 20 for _, w, a in lines], bool)
    _, places = line_dedup.fingerprints(hashes, count, alive)
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if not alive[j]:
                break
            if count[i:j + 1].sum() >= line_dedup.SURE:
                assert any(i <= p <= j and count[p:j + 1].sum() >= line_dedup.NOISE for p in places)
                break


def sentence(rng, n):
    return " ".join(rng.choice([f"w{i}" for i in range(3000)], n))


def copied_lines():
    rng = np.random.default_rng(5)
    a, b, c, d = (sentence(rng, n) for n in (60, 20, 20, 20))
    own = [sentence(rng, 12) for _ in range(12)]
    return [
        (1, "\n".join([own[0], a, own[1]])),
        (2, "\n".join([own[2], a.upper(), "", own[3]])),         # one long line again
        (3, "\n".join([b, c, d, own[4]])),
        (4, "\n".join([own[5], b, c, d, own[6], own[0]])),       # a run of three short lines again
        (5, "\n".join([own[7], b, own[8]])),                     # too short to go
        (6, "\n".join([a, own[9], a])),
        (7, None), (8, ""), (9, "\n\n"),
        (10, sentence(rng, 9000)), (10, sentence(rng, 80)),
        (11, "\n".join([own[10], a])), (11, "\n".join([own[10], a])),
        (None, "\n".join([a, own[11]])),
    ]


def test_line_dedup(spark):
    rows = copied_lines()
    df = documents(spark, rows)
    out = line_dedup.dedup(df)
    assert out.columns.count("n_lines") == 1
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    a = rows[0][1].split("\n")[1]
    # The null key comes first, so its copy of the long line is the one that stays.
    assert got[None][0][2] == 0 and got[1][0] == (rows[0][1].replace(a + "\n", ""), 3, 1)
    assert got[2][0] == ("\n".join([rows[1][1].split("\n")[0], "", rows[1][1].split("\n")[3]]), 3, 1)
    assert got[3][0][2] == 0 and got[5][0][2] == 0
    assert got[4][0][2] == 3 and got[6][0] == (rows[5][1].split("\n")[1], 3, 2)
    assert got[7] == [(None, 0, 0)] and got[8] == [("", 0, 0)] and got[9] == [("\n\n", 0, 0)]
    assert {x[2] for x in got[10]} == {0} and sorted(x[2] for x in got[11]) == [1, 2]
    assert line_dedup.dedup(df.limit(0)).count() == 0


def repeated_runs(texts):
    """Runs of 50 words or more, in whole lines, that stand earlier too."""
    seen, again = set(), 0
    for text in texts:
        lines = [x for x in words_by_line(text) if x[0]]
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += lines[j][1]
                if total >= line_dedup.SURE:
                    run = tuple(x[0] for x in lines[i:j + 1])
                    again += run in seen
                    seen.add(run)
                    break
    return again


def words_by_line(text):
    from tests.llm.frames import LOWER

    return [(x.translate(LOWER), len(words(x))) for x in (text or "").split("\n")]


def test_no_repeated_run_is_left(spark, folder):
    from piitrace.llm import queries

    before = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    rows = sorted(queries.op8_line_dedup(spark, folder).collect(), key=lambda r: r.doc_id)
    assert repeated_runs(before[k] for k in sorted(before)) > 0
    assert repeated_runs(r.text for r in rows) == 0
    kept = {x for r in rows for x, _ in words_by_line(r.text)}
    assert all(x in kept for t in before.values() for x, _ in words_by_line(t))
    assert sum(r.n_removed for r in rows) > 0


# Shingles ------------------------------------------------------------------------------------


def plain_groups(rows):
    sets = []
    for key, text in rows:
        own = words(text)
        if len(own) >= 5:
            s = {tuple(own[i:i + 5]) for i in range(len(own) - 4)}
        else:
            s = {tuple(own)} if own else set()
        sets.append((key, s))
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        (a, x), (b, y) = sets[i], sets[j]
        both = len(x & y)
        if a is None or b is None:
            continue
        if a == b or (x and y and 100 * both >= 75 * len(x | y)):
            group[max(root(i), root(j))] = min(root(i), root(j))
    least, most = {}, {}
    for i, (key, s) in enumerate(sets):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
            most[key] = max(len(s), most.get(key, 0))
    out = {(key, most[key], least[root(i)]) for i, (key, _) in enumerate(sets) if key is not None}
    return sorted(out)


def near_copies(n=60, seed=7, vocabulary=400):
    rng = np.random.default_rng(seed)
    rows, key = [], 100
    common = list(rng.choice([f"c{i}" for i in range(50)], 30))
    for size in (3, 6, 12, 30, 80, 300):
        base = [f"v{i}" for i in rng.integers(0, vocabulary, size)]
        for _ in range(n // 6):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, size // 25)))):
                own[int(rng.integers(size))] = f"e{key}"
            if rng.random() < 0.3:
                own += common[:int(rng.integers(1, 31))]
            rows.append((key, " ".join(own)))
            key += 1
    return rows


@pytest.mark.parametrize("seed", [7, 8])
def test_jaccard_groups(spark, seed):
    rows = near_copies(seed=seed) + (awkward_texts() if seed == 7 else [])
    got = jaccard_join.groups(documents(spark, rows))
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect() if r.doc_id is not None)
    assert found == plain_groups(rows)
    if seed == 7:
        assert got.where("doc_id is null").count() == 1
        assert jaccard_join.groups(documents(spark, rows).limit(0)).count() == 0


def test_links_between_different_sets(spark):
    """Every pair of similar sets is linked or held together by other links."""
    rows = near_copies(seed=9)
    members, links = jaccard_join.join(documents(spark, rows))
    of = {r.doc_id: r["class"] for r in members.collect()}
    sets = {k: {tuple(words(t)[i:i + 5]) for i in range(len(words(t)) - 4)} or {tuple(words(t))}
            for k, t in rows}
    by = {of[k]: s for k, s in sets.items()}
    for r in links.collect():
        x, y = by[r.a], by[r.b]
        assert 100 * len(x & y) >= 75 * len(x | y)


def test_light_pairs_come_out_of_their_subsets(spark):
    """A list of a single shingle that two light sets share first does not use up their pair."""
    sets = {i: np.arange(i, 20 + i, dtype=np.uint64) for i in range(1, 5)}
    size = {1: 20, 2: 20, 3: 20, 4: 21}  # the last is heavy
    sets[4] = np.arange(1, 22, dtype=np.uint64)
    classes = spark.createDataFrame([(i, size[i], bytearray(jaccard_join.bitmap(s))) for i, s in sets.items()],
                                    "id long, size long, bits binary")
    listed = {-6: (1, 2, 3, 4), -4: (1, 2, 4), 5: (1, 2), 7: (1, 2, 3), 9: (2, 3)}
    rest = spark.createDataFrame([(sig, i, size[i], i) for sig, of in listed.items() for i in of],
                                 "sig long, id long, size int, group long")
    got = sorted((r.a, r.b) for r in jaccard_join._across(rest, classes, 20, 75).collect())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def short_variants(families, copies, size, seed):
    """Windows over a long text, of which only close ones are similar."""
    rng = np.random.default_rng(seed)
    texts = []
    for f in range(families):
        at = 0
        for _ in range(copies):
            at += int(rng.integers(1, 5))
            n = size + int(rng.integers(-3, 4))
            texts.append(" ".join(f"f{f}w{i}" for i in range(at, at + n)))
    return [(int(k) + 1, t) for k, t in zip(rng.permutation(len(texts)), texts, strict=True)]


def test_short_variants_around_the_boundary(spark, monkeypatch, limit=34):
    """Step 3 has work here: most members of a list are not similar to its first or its pivot."""
    rows = short_variants(8, 40, 36, limit)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "boundary", lambda *_: limit)
    across, left = jaccard_join._across, []
    monkeypatch.setattr(jaccard_join, "_across", lambda rest, *a: (left.append(rest.count()), across(rest, *a))[1])
    got = jaccard_join.groups(documents(spark, rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_groups(rows)
    assert left[0] > 0


def test_long_lists_are_dealt_to_cells(spark, monkeypatch):
    """No cell holds a whole long list, and members of different components meet once."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    hot = [(1, i, 40, 7) for i in range(600)] + [(1, 1000, 40, 1000)]
    loose = [(2, i, 40, i) for i in range(150)] + [(2, 200 + i, 40, 8 + i // 50) for i in range(100)]
    short = [(3, i, 40, i % 3) for i in range(9)]
    rest = spark.createDataFrame(hot + loose + short, "sig long, id long, size int, group long")
    cells = collections.defaultdict(list)
    for r in jaccard_join._cells(rest).collect():
        cells[r.sig, r.x, r.y].append((r.id, r.group, r.side))
    assert max(len(v) for v in cells.values()) <= 4 * 32
    assert sum(len(v) for k, v in cells.items() if k[0] == 1) < 2 * 601
    met = collections.Counter()
    for (sig, _, _), members in cells.items():
        for (a, g, s), (b, h, t) in itertools.combinations(sorted(members), 2):
            if g != h and (s == t == 2 or s != t):
                met[sig, a, b] += 1
    want = {(s, a, b) for rows in (hot, loose, short)
            for (s, a, _, g), (_, b, _, h) in itertools.combinations(sorted(rows), 2) if g != h}
    assert set(met) == want and set(met.values()) == {1}


def test_common_values_of_rows(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(40_000, 60).tolist()) for _ in range(80)]
    own = np.repeat(np.arange(80), [len(s) for s in sets])
    values = np.array([v for s in sets for v in s])
    i, j = np.triu_indices(80, 1)
    want = [not sets[a] & sets[b] for a, b in zip(i, j, strict=True)]
    for wide in (jaccard_join.WIDE, 1):
        monkeypatch.setattr(jaccard_join, "WIDE", wide)
        assert jaccard_join._apart(i, j, own, values, 80).tolist() == want


def test_boundary_weighs_rows():
    few = jaccard_join.boundary({10: 100, 40: 100, 200: 100}, 0.0)
    many = jaccard_join.boundary({10: 100, 40: 100, 200: 100}, 500.0)
    assert few < many


def test_sql_agrees(spark, folder):
    import duckdb

    from piitrace.llm import queries

    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for query, sql in queries.ORACLES.items():
        got = queries.QUERIES[query](spark, folder)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        rows = lambda found: sorted(map(tuple, found))
        assert rows(got.select(*names).collect()) == rows(want.fetchall())
