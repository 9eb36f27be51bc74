"""A whole run learns from its training rows only."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import models as M
from tabloom.operators import split as D
from tabloom.plans import train as T
from tabloom.plans.prepare import PrepareConfig


@pytest.fixture(scope="module")
def shop(spark):
    """Held-out rows (by key hash) lie far away and hold a category of their own."""
    rows = D.split(spark.range(400), 0.2, "random", key=["id"]).withColumnRenamed("is_test", "away")
    x = F.when(F.col("away"), F.lit(1e6)).when(F.col("id") % 7 != 0, (F.col("id") % 10).cast("double"))
    return rows.select("id", x.alias("x"), F.when(F.col("away"), "z").otherwise("a").alias("kind"), (F.col("id") % 10 * 3.0).alias("y"), "away")


def config(**more):
    prepare = PrepareConfig("y", ("x", "kind"), row_key=("id",), onehot_columns=("kind",), choose_time=False)
    return T.TrainConfig(prepare, models=("linear",), select=False, **more)


@pytest.mark.parametrize("how", ["mean", "median"])
def test_nothing_is_learned_from_test_rows(shop, how):
    run = T.train(shop.drop("away"), config(missing=how))
    seen = [r.x for r in shop.where("not away").collect()]
    known = sorted(v for v in seen if v is not None)
    fill = sum(known) / len(known) if how == "mean" else (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    filled = [fill if v is None else v for v in seen]
    assert run.prepared.categories == {"kind": ["a"]}
    assert run.prepared.stats.means["x"] == pytest.approx(sum(filled) / len(filled))
    assert run.scorer.scaler.centre["x"] == pytest.approx(sum(filled) / len(filled))


def test_without_a_key_the_whole_row_decides(spark):
    """Two target values: both must be on both sides."""
    df = spark.range(500).select((F.col("id") % 2).cast("double").alias("y"), F.rand(1).alias("x"))
    run = T.train(df, T.TrainConfig(PrepareConfig("y", ("x",), choose_time=False), models=("linear", "ridge"), select=False))
    rows = {r["model"]: r for r in run.trained.metrics.collect()}
    assert rows["linear"]["error"] is None and rows["linear"]["r2"] < 0.3


def test_chronological_run_with_a_booster_and_forecasts(spark):
    df = spark.range(96).select(
        (2015 + F.floor(F.col("id") / 12)).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
        (F.col("id") * 2 + F.col("id") % 12).cast("double").alias("sales"), (F.col("id") % 5).cast("double").alias("x"),
    )
    setting = PrepareConfig("sales", ("x",), modality="forecasting", cv_folds=3)
    run = T.train(df, T.TrainConfig(setting, models=("linear", "gbm"), params={"gbm": {"trees": 5}}, horizon=3))
    rows = {r["model"]: r for r in run.trained.metrics.collect()}
    assert rows["linear"]["r2"] > 0.95 and rows["linear"]["mape"] is not None and rows["gbm"]["error"] is None
    assert run.forecasts.count() == 3 and "target_lag_1" in run.prepared.features


def test_tuned_run(spark):
    df = spark.range(300).select("id", F.rand(2).alias("x")).withColumn("y", F.col("x") * 3 + F.rand(3) * 0.1)
    setting = PrepareConfig("y", ("x",), row_key=("id",), choose_time=False)
    run = T.train(df, T.TrainConfig(setting, models=("ridge",), tune=True, trials=5, select=False))
    row = run.trained.metrics.first()
    assert row["tuned_params"]["alpha"] and row["tune_score"] > 0.9


def test_mistakes_in_the_program_are_not_hidden(spark):
    def broken(train, feats, y):
        raise KeyError("a mistake")

    M.register_model("broken", M.ModelSpec(broken))
    try:
        df = spark.range(60).select("id", F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
        train, test = D.train_test(D.split(df, 0.2, "random", key=["id"]))
        with pytest.raises(KeyError):
            M.train_models(train, test, ["x"], "y", ["linear", "broken"], M.TrainSettings(key=("id",), cv_folds=2))
    finally:
        del M.MODELS["broken"]
