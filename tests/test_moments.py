"""Sums of products at any width, against normal equations in numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import models as M
from tabloom.operators import moments as X
from tabloom.operators import profile as P


def table(spark, k, n=1200, collinear=False, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)).round(3)
    if collinear:
        x[:, -1] = x[:, 0] + x[:, 1]
    y = (x @ np.linspace(-2, 2, k) + rng.normal(size=n)).round(3)
    rows = [(i, int(i % 3), *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, ["id", "fold", *[f"f{i}" for i in range(k)], "y"])


def plain_scores(x, y, alpha, folds=3):
    scores = []
    for f in range(folds):
        test = np.arange(len(y)) % folds == f
        mx, my = x[~test].mean(axis=0), y[~test].mean()
        a = x[~test] - mx
        beta = np.linalg.lstsq(a.T @ a + alpha * np.eye(x.shape[1]), a.T @ (y[~test] - my), rcond=None)[0]
        wrong = y[test] - my - (x[test] - mx) @ beta
        scores.append(1 - (wrong**2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
    return scores


@pytest.mark.parametrize("k", [1, 59, 61, 200])
@pytest.mark.parametrize("collinear", [False, True])
def test_scores_equal_normal_equations(spark, k, collinear):
    if collinear and k < 3:
        pytest.skip("needs three features")
    x, y, df = table(spark, k, collinear=collinear)
    feats = [f"f{i}" for i in range(k)]
    began = time.time()
    assert M.fold_scores(df, feats, "y", "linear") == pytest.approx(plain_scores(x, y, 0.0), abs=1e-8)
    assert M.fold_scores(df, feats, "y", "ridge", params={"alpha": 3.0}) == pytest.approx(plain_scores(x, y, 3.0), abs=1e-8)
    assert time.time() - began < 30


def test_groups_blocks_and_missing_groups(spark):
    df = spark.range(50_000).select(
        (F.col("id") % 7).cast("double").alias("a"), F.lit(2.0).alias("b"), F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("g")
    )
    found = X.cross_products(df, [F.lit(1.0), F.col("a")], [F.col("b"), F.col("a")], F.col("g"))
    rows = [i % 7 for i in range(50_000) if i % 4 == 0]
    assert sorted(found) == [0, 2]
    assert found[0].tolist() == [[2.0 * len(rows), float(sum(rows))], [2.0 * sum(rows), float(sum(v * v for v in rows))]]
    assert X.cross_products(df.where("false"), [F.col("a")], [F.col("a")]) == {}


@pytest.mark.parametrize("k", [3, 45])
def test_correlations_with_and_without_gaps(spark, k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(300, k)).cumsum(axis=1)
    gaps = rng.random((300, k)) < 0.1
    gaps[:, 0] = False
    x[:, 1] = 4.0
    rows = [tuple(None if g else float(v) for v, g in zip(r, m, strict=True)) for r, m in zip(x, gaps, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(k)))
    found = {(a, b): r for a, b, r in P.correlation_table(df, df.columns)}
    for i in range(k):
        for j in range(i, k):
            both = ~gaps[:, i] & ~gaps[:, j]
            a, b = x[both, i], x[both, j]
            want = 0.0 if 1 in (i, j) else float(np.corrcoef(a, b)[0, 1])
            assert found[f"c{i}", f"c{j}"] == pytest.approx(want, abs=1e-9)
