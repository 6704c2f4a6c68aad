"""Vector search and vector deduplication against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from piitrace.llm import ann, vector_dedup
from piitrace.llm.components import components


def vectors(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for name in ("key", "row", "vec", "class", "code", "codes", "score", "rank", "block") if clash else ():
        df = df.withColumn(name, F.lit(1))
    return df


def clustered(n=260, dims=24, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.normal(size=(6, dims))
    for i in range(n):
        noise = 0.0 if i % 13 == 0 else float(rng.choice([0.05, 0.2, 0.35, 3.0]))
        v = centres[i % 6] + noise * rng.normal(size=dims)
        rows.append((i, [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], i % 6))
    return rows


AWKWARD = [
    (1000, None, 0), (1001, [], 0), (1002, [0.0] * 24, 0), (1003, [1.0] * 23 + [None], 0),
    (1004, [float("nan")] + [1.0] * 23, 0), (1005, [float("inf")] + [1.0] * 23, 0),
    (1006, [1.0, 2.0, 3.0], 0), (1007, [1.0, 2.0, 3.0], 0), (1020, [1.0, 2.0, 3.5], 0),
    (1008, [3e38] * 24, 0), (1009, [1e-38] * 24, 0),
]


def usable(rows):
    return [(k, np.array(v, float)) for k, v, _ in rows
            if v and None not in v and np.isfinite(v).all() and np.any(v)]


def plain_links(rows, least=0.9):
    good = usable(rows)
    links = {k: set() for k, _, _ in rows}
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1:]:
            if len(x) == len(y):
                u, v = x / np.abs(x).max(), y / np.abs(y).max()
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    out = {}
    for k in links:
        reach, todo = {k}, [k]
        while todo:
            for other in links[todo.pop()] - reach:
                reach.add(other)
                todo.append(other)
        out[k] = (len(links[k]), min(reach), k == min(reach))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = clustered() + AWKWARD
    got = vector_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == plain_links(rows)


def test_equal_vectors_and_empty_tables(spark):
    rows = [(i, [1.0, 2.0, 2.0, 0.5], 0) for i in range(500)] + [(7, [1.0, 2.0, 2.0, 0.5], 0),
                                                                (900, [-1.0, 2.0, 0.0, 0.0], 0)]
    df = vectors(spark, rows)
    got = vector_dedup.near_duplicates(df).collect()
    assert len(got) == 502 and {(r.n_links, r.component_id) for r in got} == {(500, 0), (0, 900)}
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_hashes():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9 * x + np.sqrt(1 - 0.81) * z
    a, b = vector_dedup.buckets(x), vector_dedup.buckets(y)
    met = [bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.mean(met) > 0.99


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 32))
    y = vector_dedup.hadamard(x)
    assert np.allclose((x ** 2).sum(1), (y ** 2).sum(1)) and np.allclose(vector_dedup.hadamard(y), x)


def plain_search(rows, k):
    good = usable(rows)
    out = {}
    for a, x in good:
        if a % 20 == 0:
            scores = [(-float(x @ y), b) for b, y in good if b != a and len(x) == len(y)]
            out[a] = sorted(scores)[:k]
    return out


def test_search(spark):
    rows = clustered(900) + [r for r in AWKWARD if r[0] != 1008]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=10).collect()
    want = plain_search(rows, 10)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == {k for k, v in want.items() if v}
    vecs = dict(usable(rows))
    found = []
    for k, listed in by.items():
        assert [x[0] for x in listed] == list(range(1, len(listed) + 1))
        assert len(listed) == len(want[k])
        assert [(-s, v) for _, v, s in listed] == sorted((-s, v) for _, v, s in listed)
        for _, v, s in listed:
            assert v != k and s == pytest.approx(float(vecs[k] @ vecs[v]), rel=1e-12)
        found.append(len({v for _, v, _ in listed} & {v for _, v in want[k]}) / len(listed))
    assert np.mean(found) >= 0.9
    assert [x[1] for x in by[1020]] == [1006, 1007]  # equal scores: the smaller id first


def test_search_of_few_rows(spark):
    rows = [(20, [1.0, 0.0], 0), (3, [2.0, 1.0], 0), (4, [2.0, -1.0], 0)]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (20, 1, 3, 2.0), (20, 2, 4, 2.0)]
    df = vectors(spark, rows)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.col("vec_id") > 99).count() == 0


def test_recall_on_the_sample(spark, folder):
    from piitrace.llm import queries

    rows = [(r.vec_id, list(r.embedding), 0) for r in queries.table(spark, folder, "embeddings").collect()]
    want = plain_search(rows, 20)
    got = {}
    for r in queries.op2_collision_search(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[k] & {v for _, v in w}) / len(w) for k, w in want.items()]) >= 0.9


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    loose = [(int(a), int(b)) for a, b in rng.integers(200, 300, size=(60, 2))]
    edges = [*chain, *star, *loose, (5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            group[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in group}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_vectors_are_verified():
    """Of a block of random vectors a known bound leaves few to verify, and hardly any good one is lost."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(4096, 64))
    rows /= np.sqrt((rows ** 2).sum(axis=1, keepdims=True))
    ids, asked = np.arange(4096), np.arange(0, 4096, 64)
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = [set(np.argsort(-x)[:20].tolist()) for x in scores]
    for known, share in ((None, 0.2), (np.sort(scores, axis=1)[:, -5], 0.05)):
        index = ann.Index(rows, 1.0)
        got = list(index.search(ids, ids, rows[asked], asked, 20, known))
        assert index.verified < share * len(asked) * len(rows)
        if known is None:
            assert np.mean([len(w & set(f.tolist())) / 20 for w, (_, f, _) in zip(want, got, strict=True)]) > 0.9
        else:
            best = [set(np.argsort(-x)[:5].tolist()) for x in scores]
            assert np.mean([len(w & set(f.tolist())) / 5 for w, (_, f, _) in zip(best, got, strict=True)]) > 0.9


def test_far_blocks_are_left_out():
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(500, 8)) * 0.01 + np.eye(8)[0]
    index = ann.Index(rows, 2.0)
    query = -np.eye(8)[:1]
    assert list(index.search(np.arange(500), np.arange(500), query, np.array([-1]), 5, np.array([0.5]))) == []
    assert index.verified == 0


def test_search_in_cells(spark, monkeypatch):
    """Small blocks, several cells, and a first pass over a part of the vectors."""
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "SAMPLE", 300)
    monkeypatch.setattr(ann, "QUERIES", 7)
    monkeypatch.setattr(ann, "TOGETHER", 2)
    test_search(spark)
