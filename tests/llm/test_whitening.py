"""Whitening against a symmetric eigen-solver, whole-number parts against plain arithmetic."""

import math
import random

import numpy as np
import pytest

from tabloom.catalog.registry import QUERIES
from tabloom.llm import queries as _queries  # noqa: F401
from tabloom.llm import whitening as W


def plain(vectors, k=32):
    """(n, deviations, variances, axes, covariance trace) with numpy's eigen-solver."""
    x = np.floor(64 * np.array(vectors, np.float64)) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    off = [[n * int(v) - int(t) for v, t in zip(row, s, strict=True)] for row in x]
    centred = x - s / n
    cov = centred.T @ centred / n
    values, found = np.linalg.eigh(cov)
    return n, [sum(v * v for v in row) for row in off], values[::-1][:k], found[:, ::-1][:, :k], np.trace(cov), centred


def test_query_against_eigen_solver(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, values, axes, trace, centred = plain([r.embedding for r in rows])
    found = QUERIES["op12_embedding_whitening"](spark, sf_dir)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
        "explained": "double", "identity_error": "double",
    }
    got = found.orderBy("vec_id", "component").collect()
    k = min(32, len(values))
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::k]] == deviations
    np.testing.assert_allclose([r.explained for r in got[:k]], values / trace, rtol=1e-10)
    table = np.array([r.whitened for r in got]).reshape(n, k)
    want = centred @ axes / np.sqrt(values)
    signs = np.sign((table * want).sum(axis=0))
    np.testing.assert_allclose(table, want * signs, atol=1e-8)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def determinant_polynomial(m):
    """Faddeev and LeVerrier in whole numbers."""
    d = len(m)
    c, a = [0] * d + [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        a = m.dot(a) + np.eye(d, dtype=int).astype(object) * c[d - k + 1]
        c[d - k] = -sum(int(m.dot(a)[i, i]) for i in range(d)) // k
    return c


@pytest.mark.parametrize("kind", ["dense", "sparse", "low rank", "blocks"])
def test_polynomial_roots_and_axes(spark, kind):
    rng = random.Random(kind)
    d = 9
    y = np.array([[rng.randint(-50, 50) if kind != "sparse" or rng.random() < 0.2 else 0 for _ in range(d)] for _ in range(30)], object)
    if kind == "low rank":
        y = y[:4]
    m = y.T.dot(y)
    if kind == "blocks":
        m = np.zeros((d, d), object)
        for i, v in enumerate((7, 7, 7, 4, 4, 4, 0, 1, 7)):
            m[i, i] = v
        turn = np.array([[rng.randint(-2, 2) for _ in range(2)] for _ in range(d)], object)
        m = m + turn.dot(turn.T) * 0
    c = W.characteristic(spark, m)
    assert c == determinant_polynomial(m)
    roots, s = W.largest_roots(c, d)
    want = np.linalg.eigvalsh(m.astype(float))[::-1]
    rank = int(np.linalg.matrix_rank(m.astype(float)))
    assert len(roots) == rank
    np.testing.assert_allclose([r / 2**s for r in roots], want[:rank], rtol=1e-9)
    a = W.axes(m, roots, s)
    np.testing.assert_allclose(a.T @ a, np.eye(rank), atol=1e-13)
    np.testing.assert_allclose(m.astype(float) @ a, a * [r / 2**s for r in roots], atol=1e-12 * want[0])


def test_close_roots_are_told_apart(spark):
    big = 10**9
    m = np.diag([big + 1, big, 5, 0]).astype(object)
    roots, s = W.largest_roots(W.characteristic(spark, m), 4)
    assert [r >> s for r in roots] == [big + 1, big, 5]
    assert np.abs(W.axes(m, roots, s)).round(12).tolist() == np.eye(4)[:, :3].tolist()


def test_sums_of_any_size():
    rng = np.random.default_rng(2)
    y = rng.integers(-(2**61), 2**61, (300, 3))
    exact = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert W._exact_products(y).tolist() == exact
    for value in (0, -1, 2**200, -(2**200) + 17, exact[0][1]):
        assert sum(v << (40 * i) for i, v in enumerate(W._limbs(value))) == value


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    good = [(i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(25)]
    good += [(99, good[0][1])] * 6
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [nan, 0.0, 0.0, 0.0]), (53, [inf, 0.0, 0.0, 0.0]), (54, [1.0]), (55, []), (56, [1e300] * 4)]
    schema = "vec_id int, embedding array<double>, whitened string, deviation int"
    frame = spark.createDataFrame([(i, v, "x", 7) for i, v in good + bad], schema)
    model = W.fit(frame)
    n, deviations, values, _, trace, _ = plain([v for _, v in good])
    assert model.n == n == 31 and len(model.variances) == 4
    np.testing.assert_allclose(model.variances, values, rtol=1e-10)
    np.testing.assert_allclose(model.explained, values / trace, rtol=1e-10)
    rows = model.transform(frame).collect()
    assert sorted(r.deviation for r in rows) == sorted(deviations)
    assert {r.own_whitened for r in rows} == {"x"} and {r.own_deviation for r in rows} == {7} and len(rows) == n
    assert model.identity_error(frame) < 1e-10
    assert W.fit(frame, components=2).transform(frame).select("whitened").first()[0].__len__() == 2

    empty = frame.where("false")
    none = W.fit(empty)
    assert none.n == 0 and none.transform(empty).count() == 0 and none.identity_error(empty) == 0.0
    for few in (frame.where("vec_id = 3"), frame.where("vec_id = 99")):
        alone = W.fit(few)
        assert alone.variances == () and {tuple(r.whitened) for r in alone.transform(few).collect()} == {()}
        assert {r.deviation for r in alone.transform(few).collect()} == {0}
    huge = spark.createDataFrame([(i, [2.0**50 * i, 1.0]) for i in range(4)], "vec_id int, embedding array<double>")
    wide = W.fit(huge)
    assert len(wide.variances) == 1 and math.isclose(wide.variances[0], (2.0**56) ** 2 * 1.25)
    assert {r.deviation for r in wide.transform(huge).collect()} == {None}
