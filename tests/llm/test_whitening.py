"""Exact whitening against plain linear algebra and fractions."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardline.llm import whitening as w
from shardline.llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, deviation int")


def rows_of(x):
    return [(i, [None if c is None else float(c) for c in v], "own", 1) for i, v in enumerate(x)]


def poly(roots):
    out = [1]
    for r in roots:
        out = [a - r * b for a, b in zip([0, *out], [*out, 0], strict=True)]
    return out


def test_polynomial_of_integer_matrices(spark):
    rng = np.random.default_rng(1)
    for d, size in ((1, 5), (4, 30), (9, 10**6)):
        a = rng.integers(-size, size, (d, d))
        m = [[int(x) for x in row] for row in a.astype(object) @ a.T.astype(object)]
        c = w.characteristic_polynomial(spark, m)
        for at in (0, 1, -7, 10**9):  # det(at - m) by fractions
            rows, det = [[Fraction((i == j) * at - m[i][j]) for j in range(d)] for i in range(d)], Fraction(1)
            for k in range(d):
                p = next((i for i in range(k, d) if rows[i][k]), k)
                if p != k:
                    rows[k], rows[p], det = rows[p], rows[k], -det
                det *= rows[k][k]
                for i in range(k + 1, d):
                    if rows[k][k]:
                        f = rows[i][k] / rows[k][k]
                        rows[i] = [x - f * y for x, y in zip(rows[i], rows[k], strict=True)]
            assert sum(v * at**k for k, v in enumerate(c)) == det


def test_roots_with_multiplicity():
    roots = [0, 0, 3, 7, 7, 7, 8, 10**30, 10**30 + 1]
    assert [w.roots_above(poly(roots), m) for m in (0, 3, 6, 7, 8, 10**30, 10**31)] == [7, 6, 6, 3, 2, 1, 0]
    found = w.real_roots(poly(roots), 20)
    assert [x[2] for x in found] == [1, 1, 1, 3, 1]
    for (m, s, _), want in zip(found, (10**30 + 1, 10**30, 8, 7, 3), strict=True):
        assert abs(Fraction(m, 1 << s) - want) < Fraction(1, 10**15)
    assert len(w.real_roots(poly(roots), 2)) == 2


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e15])
def test_equals_plain_algebra(spark, scale):
    """Also of entries so large that products need more than a long."""
    x = np.random.default_rng(2).normal(size=(300, 12)) * np.linspace(1, 5, 12) * scale
    df = frame(spark, rows_of(x))
    model = w.fit(df, F.col("embedding"), most=8)
    whole = [[int(np.floor(64 * c)) for c in v] for v in x]
    n, sums = len(x), [sum(c) for c in zip(*whole, strict=True)]
    assert model.n == n and list(model.sums) == sums
    exact = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in whole], object)
    values, vectors = np.linalg.eigh((exact.T @ exact / n**3).astype(float))
    assert np.allclose(model.eigenvalues, values[::-1][:8], rtol=1e-12)
    assert np.allclose(abs((model.components * vectors[:, ::-1][:, :8]).sum(0)), 1, atol=1e-12)
    assert model.identity_error < 1e-14
    got = df.select("vec_id", w.apply(F.col("embedding"), model).alias("f")).orderBy("vec_id").collect()
    assert [int(r.f.deviation) if r.f.deviation is not None else None for r in got] == [
        d if (d := sum(int(c) ** 2 for c in v)) < 10**38 else None for v in exact
    ]
    white = np.array([r.f.whitened for r in got])
    assert np.allclose(white.mean(0), 0, atol=1e-9) and np.allclose(white.T @ white / n, np.eye(8), atol=1e-9)
    assert np.isclose(sum(model.explained), sum(model.eigenvalues) / np.trace(exact.T @ exact / n**3))


def test_equal_and_zero_eigenvalues(spark):
    """Corners of a cube: three equal eigenvalues; a constant and a repeated dimension add zeros and one larger."""
    x = [(a, b, c, 5, a) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    model = w.fit(frame(spark, rows_of(x)), F.col("embedding"))
    assert np.allclose(model.eigenvalues, [2048, 1024, 1024], rtol=1e-15)
    assert np.allclose(model.components.T @ model.components, np.eye(3), atol=1e-15) and model.identity_error < 1e-14


def test_odd_vectors_take_no_part(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(60, 3))
    good = rows_of(x)
    bad = [[None, 1.0, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [], [1.0], None]
    odd = [*good, *((100 + i, v, None, None) for i, v in enumerate(bad)), (None, [1.0, 2.0, 3.0], None, None), good[0]]
    frame(spark, odd).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op11_exact_whitening"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.collect()
    assert {r.n for r in got} == {62} and len(got) == 62 * 3 and {r.component for r in got} == {1, 2, 3}
    assert {r.vec_id for r in got} == {None, *range(60)} and sum(r.vec_id == 0 for r in got) == 6


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], rows_of([(1, 2)] * 4), rows_of([(1, 2)])])
def test_nothing_to_whiten(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["op11_exact_whitening"](spark, str(tmp_path)).collect() == []


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op11_exact_whitening"](spark, folder).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(64 * np.stack(table.embedding).astype(float)).astype(np.int64) + 1_000_000
    centred = len(x) * x - x.sum(0)
    assert got.deviation.to_numpy().reshape(-1, 32)[:, 0].tolist() == (centred**2).sum(1).tolist()
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x) ** 3)
    want = centred / len(x) @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    white = got.whitened.to_numpy().reshape(-1, 32)
    assert np.allclose(white * np.sign((white * want).sum(0)), want, atol=1e-9)
    assert np.allclose(got.explained.to_numpy()[:32], values[::-1][:32] / values.sum(), rtol=1e-9)
    assert got.identity_error.max() < 1e-4 and set(got.n) == {len(x)}
