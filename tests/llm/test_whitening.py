import numpy as np
import pytest
from pyspark.sql import functions as F

from stepframe.llm.whitening import fit, identity_error, one_sided_jacobi, pivoted_cholesky, scatter_sums, whiten

SCHEMA = "vec_id long, embedding array<float>"


def _frame(spark, vectors, parts=5):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def _grid(vectors):
    return np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64)


def test_factor_and_rotations_give_the_eigenvectors():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 5, 17, 40):
        a = rnd.normal(size=(3 * n, n)) * np.logspace(0, -4, n)
        v = a.T @ a
        factor = pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v, atol=1e-14 * v.max())
        values, vectors = one_sided_jacobi(factor)
        want, space = np.linalg.eigh(v)
        assert np.allclose(values, want[::-1], rtol=1e-6, atol=0)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
        assert np.allclose(np.abs((vectors * space[:, ::-1]).sum(axis=0)), 1, atol=1e-9)


def test_less_than_full_rank():
    a = np.array([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [0.0, 0.0, 0.0], [1.0, 0.0, 1.0]])
    factor = pivoted_cholesky(a.T @ a)
    assert factor.shape == (3, 2)
    assert pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
    values, vectors = one_sided_jacobi(np.zeros((3, 0)))
    assert values.shape == (0,) and vectors.shape == (3, 0)


def test_same_as_plain_covariance(spark):
    rnd = np.random.default_rng(7)
    vectors = (rnd.normal(size=(900, 12)) @ rnd.normal(size=(12, 12)) + 5).astype(np.float32).tolist()
    df = _frame(spark, vectors).withColumn("whitened", F.lit("mine"))
    model = fit(df, components=8)
    x = _grid(vectors) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    want, space = np.linalg.eigh(centred.T @ centred / n)
    assert model.n == n and [a + n * 1_000_000 for a in model.sums] == s.tolist()
    assert np.allclose(model.eigenvalues, want[::-1][:8], rtol=1e-9)
    assert model.trace == pytest.approx(want.sum(), rel=1e-12)
    out = whiten(df, model)
    assert out.columns == ["vec_id", "embedding", "deviation", "whitened"]
    assert identity_error(out, 8) < 1e-9
    for row in out.collect():
        y = centred[row.vec_id] @ space[:, ::-1][:, :8] / np.sqrt(want[::-1][:8])
        assert np.allclose(np.abs(row.whitened), np.abs(y), atol=1e-7)
        assert row.deviation == sum(int(n * int(a) - int(b)) ** 2 for a, b in zip(x[row.vec_id], s))


def test_sums_are_exact_for_far_entries(spark):
    rows = [[1e14, -3.0, 7.0], [-9e13, 4.5, 1e9], [123456789.0, 2.0, -1e12]] * 5
    z = np.floor(64 * np.array(rows)).clip(-1e15, 1e15).astype(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in z], "z array<long>").repartition(4)
    n, sums, raw = scatter_sums(df, 3)
    assert n == 15 and sums == [sum(v[k] for v in z) for k in range(3)]
    assert raw == [[sum(v[i] * v[j] for v in z) for j in range(3)] for i in range(3)]
    far = _frame(spark, [[1e30, 1.0], [-1e30, 2.0], [5.0, 9.0]])
    out = whiten(far, fit(far)).collect()
    assert len(out) == 3 and all(np.isfinite(r.whitened).all() for r in out) and {r.deviation for r in out} == {None, 1331200}


def test_odd_rows(spark):
    good = [[float(i % 7), float(i % 3), 1.0] for i in range(60)]
    odd = [None, [1.0, None, 1.0], [float("nan"), 1.0, 1.0], [1.0, float("-inf"), 0.0], [], [1.0], [1.0] * 4]
    df = _frame(spark, good + odd).unionByName(spark.createDataFrame([(None, good[0])], SCHEMA))
    model = fit(df)
    assert model.n == 61 and model.components.shape == (3, 2)
    out = whiten(df, model).collect()
    assert len(out) == 61 and sum(r.vec_id is None for r in out) == 1
    assert identity_error(whiten(df, model), 2) < 1e-12


def test_nothing_to_fit(spark):
    assert fit(_frame(spark, []).limit(0)) is None
    assert fit(_frame(spark, [None, [float("nan")]])) is None
    alike = _frame(spark, [[1.0, 2.0]] * 9)
    model = fit(alike)
    assert model.n == 9 and model.components.shape == (2, 0)
    assert [r.whitened for r in whiten(alike, model).collect()] == [[]] * 9
    empty = _frame(spark, [[], []])
    assert fit(empty).width == 0 and whiten(empty, fit(empty)).count() == 2
