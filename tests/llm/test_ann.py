"""Posting lists against all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardline.llm import ann


def best(rows, queries, k):
    """{query: [(id, product)]} over (id, vector) rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        product = x @ x[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -product)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(product[i])) for i in order]
    return out


def run(spark, rows, k, **kw):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, list int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=k, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    return got


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def test_recall_with_many_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rows = vectors(2000, 16, 1)
    got = run(spark, rows, 10, list_rows=100)
    want = best(rows, range(0, 2000, 20), 10)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    exact = dict(rows)
    for q, found in got.items():
        assert len(found) == 10 and q not in {i for i, _ in found}
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(np.dot(np.float64(exact[q]), np.float64(exact[i])))) < 1e-9 for i, s in found)


def test_recall_with_hundreds_of_lists(spark):
    """Directions spread evenly, with the ratio, sample and copies of production."""
    x = np.random.default_rng(6).normal(size=(12000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x.astype(np.float32))}))
    asked = np.arange(0, len(x), 40)
    got = {}
    for r in ann.nearest(rows, F.col("vec_id") % 40 == 0, list_rows=24).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    product = x[asked] @ x.T
    product[np.arange(len(asked)), asked] = -2
    want = np.argsort(-product, 1)[:, :20]
    assert np.mean([len(got[q] & set(w)) / 20 for q, w in zip(asked.tolist(), want.tolist(), strict=True)]) >= 0.97


def test_copies_ties_and_few_rows(spark):
    random.seed(3)
    one, two = [1.0, 0.0], [0.5, 0.5]
    rows = [(i, one if i % 3 else two) for i in range(200)]
    got = run(spark, rows, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in best(rows, range(0, 200, 20), 5).items()}
    assert run(spark, [(0, one), (1, two)], 5) == {0: [(1, 0.5)]}
    assert run(spark, [(20, one)], 5) == {}


def test_unusable_vectors(spark):
    bad = [(40, None), (60, []), (80, [0.0, 0.0]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [1.0, 2.0, 3.0])]
    good = [(0, [1.0, 2.0]), (5, [2.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0])]
    df = spark.createDataFrame([*good, *bad, (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 5, 4.0), (0, 6, 3.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_halves_are_balanced():
    rng = np.random.default_rng(2)
    assert len(ann._halves(rng.normal(size=(640, 8)), 10, rng)) == 64


@pytest.mark.parametrize("ratio", [0.05, 0.3])
def test_graph_search_finds_the_near_centroids(ratio):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    index = ann.Lists.fit(x, 300, float(np.sqrt((x * x).sum(1).max())))
    points = ann.lift(x[:200], index.norm)
    found = np.isfinite(index.search(points, ratio))
    gap = ann.distances(points, index.centroids)
    near = gap <= gap.min(1, keepdims=True) * (1 + ratio)
    assert (found & near).sum() >= 0.97 * near.sum()
