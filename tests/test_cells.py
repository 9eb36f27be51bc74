"""Trees fitted to cells (rows of equal features as one weighted row) against trees fitted to the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import cells as C
from tabloom.operators import evaluate as V
from tabloom.operators import models as M

FEATS = ["a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(5)
    n = 1500
    a, b = rng.randint(0, 5, n).astype(float), rng.randint(0, 3, n).astype(float)
    y = 3 * a + 5 * (b == 1) * a + rng.randn(n)
    rows = [
        (None if i % 40 == 0 else float(a[i]), float(b[i]) if i % 50 else float("nan"), None if i % 33 == 0 else float(y[i]), i % 3)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "a double, b double, y double, fold int").repartition(3).cache()


def by_rows(monkeypatch):
    monkeypatch.setattr(C, "cells", lambda *_, **__: None)


def guesses(fitted, data):
    return [(str(r["a"]), str(r["b"]), r["g"]) for r in fitted.predict(data.select("a", "b"), "g").distinct().orderBy("a", "b").collect()]


@pytest.mark.parametrize(
    "name,params",
    [
        ("dt", {}), ("dt", {"min_split": 120}), ("dt", {"min_split": 4000}), ("gbm", {"trees": 12}), ("xgboost", {"trees": 6}),
        ("lgbm", {"trees": 6}), ("adaboost", {"trees": 6, "max_depth": 2}),
    ],
)
def test_same_model_as_from_rows(data, monkeypatch, name, params):
    assert C.cells(data, FEATS, "y").count() <= 18
    quick = guesses(M.fit_model(data, FEATS, "y", name, params), data)
    scores = M.fold_scores(data, FEATS, "y", name, params=params)
    by_rows(monkeypatch)
    slow = guesses(M.fit_model(data, FEATS, "y", name, params), data)
    assert [r[:2] for r in quick] == [r[:2] for r in slow]
    np.testing.assert_allclose([g for *_, g in quick], [g for *_, g in slow], rtol=1e-9)
    np.testing.assert_allclose(scores, M.fold_scores(data, FEATS, "y", name, params=params), rtol=1e-9)


def test_forest_of_resampled_cells(data, monkeypatch):
    """Resamples differ, so trees do; the mean comes near that of a forest of rows, and twice the same."""
    fitted = M.fit_model(data, FEATS, "y", "rf", {"trees": 30, "max_features": "all"})
    assert len({tuple(t.toDebugString.split("\n")[1:]) for t in fitted.model.trees}) > 1
    assert guesses(fitted, data) == guesses(M.fit_model(data, FEATS, "y", "rf", {"trees": 30, "max_features": "all"}), data)
    assert sum(fitted.model.featureImportances.toArray()) == pytest.approx(1.0)
    quick = guesses(fitted, data)
    by_rows(monkeypatch)
    slow = guesses(M.fit_model(data, FEATS, "y", "rf", {"trees": 30, "max_features": "all"}), data)
    np.testing.assert_allclose([g for *_, g in quick], [g for *_, g in slow], atol=0.8)


def test_draws_are_poisson(data, spark):
    made = C.cells(data, FEATS, "y")
    drawn = C.drawn_cells(data, FEATS, "y", made, 200, 1)
    sums = np.array([r[0] for r in drawn.groupBy("tree").agg(F.sum("_n")).select("sum(_n)").collect()])
    assert len(sums) == 200 and abs(sums.mean() - 1500) < 20 and 25 < sums.std() < 55


def test_r2_of_cells(data):
    made = C.cells(data, FEATS, "y")
    rows = data.withColumn("g", F.coalesce(F.nanvl("b", F.lit(0.0)), F.lit(0.0)) * 2)
    want = V.regression_metrics(rows, "y", "g", 12).first()["r2"]
    assert C.r2(made.withColumn("g", F.col("b") * 2), "g") == pytest.approx(want, abs=1e-10)
    constant = C.cells(data.withColumn("y", F.lit(0.1)), FEATS, "y")
    assert C.r2(constant.withColumn("g", F.lit(0.1)), "g") == 1.0 and C.r2(constant.withColumn("g", F.lit(0.2)), "g") == 0.0


def test_rows_that_hardly_repeat_stay_rows(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    assert C.cells(df, ["x"], "y") is None


def test_texts_and_categories_stay_rows(data):
    """A text may be told by its statistic, in every fold; as a number it would tell nothing."""
    texts = data.withColumn("t", F.when(F.col("a") > 2, "high").otherwise("low"))
    assert C.cells(texts, ["t", "b"], "y") is None
    assert min(M.fold_scores(texts, ["t"], "y", "catboost", params={"trees": 3})) > 0.2
    known = data.withColumn("a", F.col("a").alias("a", metadata={"ml_attr": {"type": "nominal", "vals": list("abcdefgh")}}))
    assert C.cells(known, FEATS, "y") is None


def test_cut_points(spark):
    """As many as Spark's trees use: between all values where they are few, else at quantiles."""
    x = [float(i % 5) if i % 100 else 70.0 for i in range(2000)]
    rows = [(x[i], float(i), None if i % 4 else float(i % 40)) for i in range(2000)]
    df = spark.createDataFrame(rows, "few double, many double, gaps double")
    cuts = C.cut_points(df, df.columns, 32)
    assert cuts["few"] == [0.5, 1.5, 2.5, 3.5, 37.0]
    np.testing.assert_allclose(cuts["many"], [2000 * i / 32 for i in range(1, 32)], atol=3)
    assert cuts["gaps"] == [2.0 + 4 * i for i in range(9)]
    told, names = C.binned(df, ["many", "few", "gaps"], {"few": cuts["few"], "gaps": cuts["gaps"]})
    assert names == ["many", "_bin1", "_bin2"] and told.columns == [*df.columns, "_bin1", "_bin2"]
    assert {(r.few, r._bin1) for r in told.collect()} == {(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 4.0), (70.0, 5.0)}
    assert C.cut_points(df.where("few > 99"), ["few"], 32) == {"few": []}
