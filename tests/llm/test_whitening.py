"""Whitening against numpy's eigenvectors, and the bidiagonal solver on hard matrices."""

import math

import numpy as np
import pytest

from corpusloom.llm import bidiagonal, queries, whitening

RNG = np.random.default_rng(1)
Q = np.linalg.qr(RNG.standard_normal((30, 30)))[0]
BANDED = np.diag(np.abs(np.arange(21) - 10.0) + 1e-3) + np.diag(np.ones(20), 1)


@pytest.mark.parametrize("matrix", [
    RNG.standard_normal((40, 40)), RNG.standard_normal((30, 4)) @ RNG.standard_normal((4, 30)), np.eye(20), Q, np.zeros((6, 6)), np.array([[3.0]]),
    RNG.standard_normal((30, 30)) * 10.0 ** -np.arange(30), RNG.standard_normal((30, 30)) * 10.0 ** np.arange(-15, 15),
    np.diag(np.repeat([5, 3, 3 + 1e-9, 1, 1e-5], 6)) @ Q, BANDED, np.kron(np.eye(3), np.linalg.cholesky(BANDED.T @ BANDED + np.eye(21)).T) + 1e-8 * np.eye(63),
    np.repeat(RNG.standard_normal((30, 10)), 3, axis=1), np.diag([0.0, 2.0, 0.0, 1.0]), np.triu(np.ones((25, 25))),
], ids=lambda m: f"{len(m)}")
def test_solver(matrix):
    e, v = bidiagonal.right_vectors(matrix)
    want = np.linalg.svd(matrix, compute_uv=False) ** 2
    top = max(want[0], 1e-300)
    assert np.abs(e - want).max() <= 1e-13 * top
    assert np.abs(v.T @ v - np.eye(len(v))).max() < 1e-12
    assert np.abs(matrix.T @ (matrix @ v) - v * e).max() <= 1e-13 * top


def test_small_values_are_accurate():
    """Of a bidiagonal matrix, also values far below the largest keep their digits: the product of all is the determinant."""
    a, b = 10.0 ** -np.arange(12), 0.5 * 10.0 ** -np.arange(11)
    assert math.isclose(float(np.prod(np.sqrt(bidiagonal.squared_values(a, b)))), float(np.prod(a)), rel_tol=1e-12)


def check(rows, kept, components):
    """Against numpy over the usable rows (id, vector)."""
    x = np.floor(64 * np.array([v for _, v in kept], np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centre = x - sums / n
    values, vectors = np.linalg.eigh(centre.T @ centre / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == {i for i, _ in kept} and len(rows) == n * components
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    white = np.array([[r.whitened for r in sorted(by_id[i], key=lambda r: r.component)[:: len(by_id[i]) // components]] for i, _ in kept])
    want = centre @ vectors[:, :components] / np.sqrt(values[:components])
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-6
    far = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums, strict=True)) for (i, _), v in zip(kept, x, strict=True)}
    for r in rows:
        assert r.n == n and r.deviation == far[r.vec_id]
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.op13_whiten(spark, sf)
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    kept = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
            if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(df.collect(), kept, 32)


def test_odd_rows(spark):
    """Null, empty, short and non-finite vectors go; null ids, repeated rows and a hot vector stay; clashing columns do not matter."""
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.standard_normal(5) * 3]) for i in range(60)] + [(i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(60, 100)]
    good += [(3, good[3][1])]
    bad = [(200, None), (201, []), (202, [1.0]), (203, [1.0, None, 2.0, 3.0, 4.0]), (204, [math.nan] * 5), (205, [1.0, math.inf, 2.0, 3.0, 4.0]), (206, [-math.inf] * 5)]
    schema = "vec_id long, embedding array<double>, x int, id string, component string, n int"
    frame = spark.createDataFrame([(i, v, 1, "a", None, 2) for i, v in good + bad], schema).repartition(7)
    check(whitening.whiten(frame).collect(), good, 5)
    again = spark.createDataFrame([(None, v, 1, "a", None, 2) for _, v in good], schema)
    assert whitening.whiten(again, components=2).where("vec_id is null").count() == 2 * len(good)


def test_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(20)], schema)
    rows = whitening.whiten(flat).collect()
    assert len(rows) == 20 and rows[0].component == 1 and math.isclose(rows[0].explained, 1.0)


def test_large_numbers_stay_exact():
    x = np.array([[2**60, 1_000_000], [5, 1_000_064]], np.int64)
    sums = x.sum(axis=0)
    assert whitening.squared_distance(x, 2, sums) == [None, None]
    near = np.array([[1_000_000, 1_000_100], [1_000_064, 999_900]], np.int64)
    assert whitening.squared_distance(near, 2, near.sum(axis=0)) == [64**2 + 200**2] * 2


def test_spark_id_types(spark):
    frame = spark.createDataFrame([(f"v{i}", [float(i % 5), float(i % 7), float(i)]) for i in range(40)], "vec_id string, embedding array<float>")
    assert whitening.whiten(frame).dtypes[0] == ("vec_id", "string") and whitening.whiten(frame).count() == 120
