"""Nearest-neighbour mutual information against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.hashing import key_hash
from tabloom.operators import neighbours as N


def psi(m):
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(m)))


def plain(x, y, u, v, k=3):
    """All pairs."""
    x, y = x / (x.std() or 1), y / (y.std() or 1)
    x = x + N.NOISE * max(1.0, np.abs(x).mean()) * u
    y = y + N.NOISE * max(1.0, np.abs(y).mean()) * v
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    r = np.sort(np.maximum(dx, dy), axis=1)[:, k] * (1 - 1e-9)
    cx, cy = (dx < r[:, None]).sum(axis=1), (dy < r[:, None]).sum(axis=1)
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(c) for c in cx]) - np.mean([psi(c) for c in cy]))


def frame_of(spark, x, y):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double").repartition(5)


def draws_of(frame):
    rows = frame.select("id", *[(key_hash(["id"], s) / 2**32 - 0.5).alias(s) for s in ("u", "v")]).orderBy("id").collect()
    return np.array([r.u for r in rows]), np.array([r.v for r in rows])


@pytest.mark.parametrize("kind", ["related", "independent", "clusters", "few values", "one heap"])
@pytest.mark.parametrize("cell_rows,limit", [(64, 10**6), (512, 800)])
def test_equals_all_pairs(spark, kind, cell_rows, limit):
    rng = np.random.default_rng(7)
    n = 2000
    x = rng.normal(size=n)
    y = {"related": x**2 + rng.normal(size=n) * 0.3, "independent": rng.normal(size=n)}.get(kind, x)
    if kind == "clusters":
        x, y = rng.choice([0.0, 100.0, 101.0], n) + rng.normal(size=n) * 0.01, rng.choice([0.0, 5.0], n) + rng.normal(size=n) * 0.001
    if kind == "few values":
        x, y = rng.integers(0, 5, n).astype(float), rng.integers(0, 3, n).astype(float)
    if kind == "one heap":
        x, y = np.where(rng.random(n) < 0.4, 3.0, rng.normal(size=n)), np.where(rng.random(n) < 0.4, 2.0, rng.normal(size=n))
    frame = frame_of(spark, x, y)
    row = N.knn_mutual_information(frame, "a", "b", ["id"], cell_rows=cell_rows, limit=limit).first()
    # Equal values lie apart by the tie-breaking share only, where doubles round their sums.
    rounding = 1e-3 if kind in ("few values", "one heap") else 1e-6
    assert row["n"] == n and row["mi"] == pytest.approx(plain(x, y, *draws_of(frame)), abs=rounding)


def test_known_value(spark):
    """Two normal columns with correlation 0.8: MI is -log(1 - 0.64) / 2."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=20_000)
    y = 0.8 * x + 0.6 * rng.normal(size=20_000)
    row = N.knn_mutual_information(frame_of(spark, x, y), "a", "b", ["id"]).first()
    assert row["mi"] == pytest.approx(0.5108, abs=0.03)


def test_cells_stay_small_and_visits_few(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=4000) * 1e-6, rng.normal(size=1000)])
    frame = frame_of(spark, x, rng.normal(size=5000)).select(F.col("id").cast("bigint").alias("row"), F.col("a").alias("x"), F.col("b").alias("y"))
    along, across = N._grid(frame, 5000, 50)
    cells = {}
    for a, b in frame.select("x", "y").collect():
        s = int(np.searchsorted(along, a, "right"))
        cells[s, int(np.searchsorted(across[s], b, "right"))] = cells.get((s, int(np.searchsorted(across[s], b, "right"))), 0) + 1
    assert max(cells.values()) < 4 * 50


def test_gaps_and_few_rows(spark):
    frame = spark.createDataFrame([(1, 1.0, None), (2, None, 2.0), (3, 1.0, 1.0), (4, 2.0, 5.0)], "id int, a double, b double")
    assert tuple(N.knn_mutual_information(frame, "a", "b", ["id"]).first()) == (0.0, 0)
    assert tuple(N.knn_mutual_information(frame.where("false"), "a", "b", ["id"]).first()) == (0.0, 0)
    five = spark.range(5).select("id", F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    assert N.knn_mutual_information(five, "a", "b", ["id"]).first()["n"] == 5
