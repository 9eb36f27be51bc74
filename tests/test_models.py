"""Models: closed forms, planted signals, reproducibility, failures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import evaluate as V
from tabloom.operators import models as M
from tabloom.operators import moments
from tabloom.operators import split as D


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.RandomState(3)
    a, b, c = rng.randn(400), rng.randn(400) * 5 + 100, rng.randint(0, 3, 400)
    y = 4 * a - 2 * b + np.where(c == 1, 15, 0) + rng.randn(400) * 0.5
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3).cache()


FEATS = ["a", "b", "c"]


def matrix(data):
    rows = data.orderBy("id").collect()
    return np.array([[r[f] for f in FEATS] for r in rows]), np.array([r["y"] for r in rows])


@pytest.mark.parametrize("alpha", [0.5, 40.0])
def test_ridge_closed_form(data, alpha):
    x, y = matrix(data)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    assert np.allclose(M.fit_ridge(data, FEATS, "y", alpha).model.coefficients.toArray(), want, rtol=1e-6)
    parts = moments.fold_moments(data.withColumn("fold", F.lit(0)), FEATS, "y", "fold")
    assert np.allclose(moments.solve(parts[0], alpha)[0], want, rtol=1e-8)


def test_moment_scores_equal_fitted_scores(data):
    marked = D.folds(data, 4, ["id"])
    quick = M.fold_scores(marked, FEATS, "y", "ridge", params={"alpha": 2.0})
    slow = []
    for k in range(4):
        fitted = M.fit_ridge(marked.where(F.col("fold") != k), FEATS, "y", 2.0)
        scored = fitted.predict(marked.where(F.col("fold") == k))
        slow.append(V.regression_metrics(scored, "y", "prediction", 12).first()["r2"])
    assert np.allclose(quick, slow, atol=1e-8)


def test_time_folds_train_on_the_past(data):
    marked = D.time_folds(data, 3, ["id"])
    assert len(M.fold_scores(marked, FEATS, "y", "linear", chronological=True)) == 3


@pytest.mark.parametrize(
    "name,params",
    [("dt", {}), ("rf", {"trees": 15, "max_depth": 6}), ("gbm", {"trees": 20}), ("lgbm", {"trees": 8, "leaves": 15})],
)
def test_trees_beat_the_mean_and_repeat(data, name, params):
    train, test = D.train_test(D.split(data, 0.25, "random", key=["id"]))
    first = M.fit_model(train, FEATS, "y", name, params)
    assert V.regression_metrics(first.predict(test), "y", "prediction").first()["r2"] > 0.4
    again = M.fit_model(train, FEATS, "y", name, params)
    gap = first.predict(test, "p").join(again.predict(test, "q").select("id", "q"), "id")
    assert gap.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] == 0.0


def test_search(data):
    found = M.search(data, FEATS, "y", "ridge", ["id"], trials=6)
    assert len(found.trials) == 6
    assert found.best_score == max(s for _, s in found.trials)
    assert found.trials == M.search(data, FEATS, "y", "ridge", ["id"], trials=6).trials
    assert M.search(data, FEATS, "y", "linear", ["id"]).best_params == {}


def test_comparison_goes_on_after_a_failure(data):
    train, test = D.train_test(D.split(data, 0.25, "random", key=["id"]))
    settings = M.TrainSettings(key=("id",), cv_folds=3)
    done = M.train_models(train, test, FEATS, "y", ["linear", "missing", "ridge"], settings)
    rows = {r["model"]: r for r in done.metrics.collect()}
    assert "not registered" in rows["missing"]["error"]
    # The middle category's jump is not linear, so a straight fit explains only a part.
    assert rows["linear"]["band"] in ("Fair", "Good") and rows["linear"]["cv_r2"] > 0.5
    assert done.best in ("linear", "ridge") and rows[done.best]["is_best"]
    assert rows["linear"]["ci_worst"] <= rows["linear"]["accuracy_pct"] <= rows["linear"]["ci_best"]


def test_bootstrap_behaves_like_resampling(spark):
    n = 3000
    rng = np.random.RandomState(5)
    hit = rng.rand(n) < 0.7
    df = spark.createDataFrame([(i, 1.0, 1.0 if hit[i] else 0.0) for i in range(n)], "id long, y double, p double")
    row = V.bootstrap(df, ["id"], "y", "p", "classification").first()
    share, deviation = 100 * hit.mean(), 100 * np.sqrt(0.21 / n)
    assert abs(row["ci_average"] - share) < deviation
    assert abs((row["ci_upper"] - row["ci_lower"]) - 2 * 1.96 * deviation) < 1.2 * deviation


def test_metric_corner_cases(spark):
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert V.regression_metrics(flat, "y", "p").first().asDict() == {"r2": 1.0, "rmse": 0.0, "mae": 0.0}
    zeros = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "y double, p double")
    assert V.mape(zeros, "y", "p").first()[0] == 0.0
    assert V.accuracy_pct(zeros, "y", "p").first()[0] == 50.0
    one = spark.createDataFrame([(1.0, 3.0)], "y double, p double")
    assert V.regression_metrics(one, "y", "p").first()["r2"] == 0.0
