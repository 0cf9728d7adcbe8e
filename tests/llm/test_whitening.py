"""Operator 11 against exact sums and numpy's eigenvectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidelog.llm import queries as Q
from tidelog.llm import whitening
from tidelog.llm._common import table
from tidelog.llm.whitening import jacobi, rounds, whiten


def exact_covariance(x):
    """In whole numbers: n^2 times the covariance of rows of whole numbers."""
    n = len(x)
    sums = [sum(r[i] for r in x) for i in range(len(x[0]))]
    z = np.array([[n * v - s for v, s in zip(r, sums, strict=True)] for r in x], dtype=object)
    return n, sums, z, (z.T @ z).astype(object)  # n^2 sum of centred products = n^3 V


def check(rows, vectors, most=32):
    """``rows``: of whiten; ``vectors``: {id: floats}, ids distinct."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors.values()]
    n, sums, z, products = exact_covariance(x)
    v = np.array(products / n**3, dtype=np.float64) if n < 100 else np.array([[float(p) for p in r] for r in products]) / float(n) ** 3
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(most, int((values > values[0] * len(v) * 2**-52).sum()))
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == n * k
    whitened = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in vectors])
    centred = np.array([[float(a) for a in r] for r in z]) / n
    for i, r in zip(vectors, z, strict=True):
        assert {got[i, c].deviation for c in range(1, k + 1)} == {sum(int(a) ** 2 for a in r)}
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-4 and len({r.identity_error for r in rows}) == 1
    for c in range(1, k + 1):
        assert list({got[i, c].explained for i in vectors}) == [pytest.approx(values[c - 1] / np.trace(v), rel=1e-4)]
        # the direction that gave these numbers is a unit eigenvector: V w = e w
        direction = v @ np.linalg.lstsq(centred, whitened[:, c - 1] * np.sqrt(values[c - 1]), rcond=None)[0]
        assert np.linalg.norm(direction) == pytest.approx(values[c - 1], rel=1e-8)
    covariance = whitened.T @ whitened / n - np.outer(whitened.mean(0), whitened.mean(0))
    assert np.abs(covariance - np.eye(k)).max() == pytest.approx(rows[0].identity_error, abs=1e-9)
    return whitened


def test_whitening(spark, sf_dir):
    vectors = {r.vec_id: [float(c) for c in r.embedding] for r in table(spark, sf_dir, "embeddings").collect()}
    rows = Q.op11_whitening(spark, sf_dir).collect()
    whitened = check(rows, vectors)
    x = np.floor(64 * np.array(list(vectors.values())))
    _, directions = np.linalg.eigh(np.cov(x.T, bias=True))
    mine = (x - x.mean(0)) @ directions[:, ::-1][:, :32]
    assert np.abs(np.abs(mine / mine.std(0)) - np.abs(whitened)).max() < 1e-8


@pytest.mark.parametrize("dealt", [1, 7])
def test_whitening_is_the_same_however_rows_are_dealt(spark, sf_dir, monkeypatch, dealt):
    monkeypatch.setattr(whitening, "SLICE_NUMBERS", 1000)
    rows = table(spark, sf_dir, "embeddings").repartition(dealt).select("embedding")
    whole = whitening.fit(table(spark, sf_dir, "embeddings").select("embedding"))
    again = whitening.fit(rows)
    assert again.sums == whole.sums and (again.values == whole.values).all() and (again.vectors == whole.vectors).all()


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(1)
    odd = [None, [], [1.0], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0]]
    good = rng.normal(size=(30, 3)).tolist()
    rows = [(k, v, "x", 1) for k, v in enumerate(good + odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n int")
    check(whiten(df).collect(), dict(enumerate(good)))
    assert whiten(df.limit(0)).collect() == []
    assert whiten(df.where("vec_id = 3")).collect() == []  # one row doesn't vary
    assert whiten(df.where("vec_id >= 30")).collect() == []
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert whiten(same).collect() == []
    repeated = spark.createDataFrame([(None, [0.0, 1.0]), (None, [0.0, 1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = whiten(repeated).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (1, 1)]  # the other direction doesn't vary
    assert len({r.whitened for r in got if r.vec_id is None}) == 1


def test_whitening_of_wide_and_of_far_values(spark):
    rng = np.random.default_rng(2)
    wide = {k: v for k, v in enumerate((rng.normal(size=(40, 4)) * [1e-1, 1, 1e2, 1e4]).tolist())}
    df = spark.createDataFrame(list(wide.items()), "vec_id long, embedding array<double>")
    check(whiten(df).collect(), wide)
    wider = {k: [v[0], v[1], 1e3 * v[2], 1e7 * v[3]] for k, v in wide.items()}  # products beyond 2**53; two directions are below rounding
    got = whiten(spark.createDataFrame(list(wider.items()), "vec_id long, embedding array<double>")).collect()
    assert len(got) == 80 and got[0].identity_error < 1e-9
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = whiten(far).collect()
    assert {r.n for r in got} == {3} and None in {r.deviation for r in got}
    assert all(math.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_rounds_pair_each_two_once(n):
    pairs = [(int(a), int(b)) for p, q in rounds(n) for a, b in zip(p, q, strict=True)] if n > 1 else []
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert all(len(set(p) | set(q)) == 2 * len(p) for p, q in rounds(n))


def test_small_eigenvalues_are_accurate():
    """A graded matrix: eigenvalues over twenty powers of ten, where reduction to tridiagonal form loses the small ones."""
    d = np.array([1e10, 1e5, 1.0, 1e-5, 1e-10])
    a = d[:, None] * (np.full((5, 5), 0.1) + 0.9 * np.eye(5)) * d
    values, vectors = jacobi(a)
    from fractions import Fraction

    # determinant, exactly, against the product of the eigenvalues
    m = [[Fraction(float(x)) for x in r] for r in a]
    det = Fraction(1)
    for k in range(5):
        det *= m[k][k]
        for i in range(k + 1, 5):
            f = m[i][k] / m[k][k]
            m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
    assert float(np.prod([float(v) for v in values])) == pytest.approx(float(det), rel=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-14


def test_rotations_of_a_singular_matrix_end():
    x = np.random.default_rng(3).normal(size=(3, 9))
    values, vectors = jacobi(x.T @ x)
    assert np.allclose(values[:3], np.linalg.eigvalsh(x @ x.T)[::-1]) and np.abs(values[3:]).max() < 1e-12
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
