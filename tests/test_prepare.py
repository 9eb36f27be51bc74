"""The temporal preparation example, batch and stream scoring."""

import math

import pytest
from pyspark.sql import functions as F

from tabloom.operators import encode as E
from tabloom.operators import models as M
from tabloom.plans import prepare as P
from tabloom.plans import score as R
from tabloom.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def sales(spark):
    months = ["January", "feb", "Mar", "april", "May", "june"]
    rows = [(2023, m, 100.0 + 10 * i, 1.0 + i, "A" if i % 2 == 0 else "B") for i, m in enumerate(months)]
    return spark.createDataFrame(rows, "year int, month string, sales double, price double, cat_col string").repartition(3)


CONFIG = P.PrepareConfig(
    target="sales", features=("year", "month", "price", "cat_col"), onehot_columns=("cat_col", "month"),
    split_method="chronological",
)
FEATURES = (
    "price", "elapsed_time", "month_sin", "month_cos", "cat_col_A", "cat_col_B", "target_lag_1", "target_lag_yoy",
    "target_yoy_growth", "target_rolling_mean_3", "target_rolling_mean_yoy",
)


def test_columns_and_order(sales):
    frame, state = P.fit_prepare(sales, CONFIG)
    assert state.features == FEATURES
    assert state.categories == {"cat_col": ["A", "B"]}
    assert set(frame.columns) == {"year", "month", "sales", "price", "cat_col", *FEATURES}
    lags = [r["target_lag_1"] for r in frame.orderBy("year", "month").collect()]
    assert lags == [100.0, 100.0, 110.0, 120.0, 130.0, 140.0]


def test_single_record(spark, sales):
    _, state = P.fit_prepare(sales, CONFIG)
    record = spark.createDataFrame([(2024, "March", 2.0, "A")], "year int, month string, price double, cat_col string")
    row = P.apply_prepare(record, state).first()
    want = {
        "price": 2.0, "elapsed_time": 14.0, "month_sin": 1.0, "month_cos": 0.0, "cat_col_A": 1.0, "cat_col_B": 0.0,
        "target_lag_1": 116.66666666666667, "target_lag_yoy": 0.0, "target_yoy_growth": 0.0,
        "target_rolling_mean_3": 110.83333333333333, "target_rolling_mean_yoy": 108.33333333333333,
    }
    assert set(row.asDict()) == set(want)
    for name, value in want.items():
        assert math.isclose(row[name], value, abs_tol=1e-9), name


def test_unseen_category_and_missing_columns(spark, sales):
    _, state = P.fit_prepare(sales, CONFIG)
    record = spark.createDataFrame([("Z",), (None,)], "cat_col string")
    rows = P.apply_prepare(record, state).collect()
    assert rows[0]["cat_col_A"] == rows[0]["cat_col_B"] == 0.0
    assert rows[1]["cat_col_A"] == 1.0  # the most frequent training value
    assert rows[0]["price"] == 3.5


def test_raw_time_is_used_when_better(spark):
    rows = [(2000 + i // 12, i % 12 + 1, float((i % 12 + 1) * 100)) for i in range(120)]
    df = spark.createDataFrame(rows, "year int, month int, y double")
    config = P.PrepareConfig(target="y", features=("year", "month"), split_method="random", row_key=("year", "month"))
    _, state = P.fit_prepare(df, config)
    assert not state.use_combined
    assert {"year", "month"} <= set(state.features) and "elapsed_time" not in state.features


@pytest.fixture(scope="module")
def scorer(spark):
    rows = [(i, float(i % 10), "u" if i % 3 else "w", 5.0 * (i % 10) + (0 if i % 3 else 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, kind string, y double")
    config = P.PrepareConfig(target="y", features=("x", "kind"), onehot_columns=("kind",), row_key=("id",))
    frame, state = P.fit_prepare(df, config)
    scaler = E.fit_scaler(frame, state.features, "zscore")
    fitted = M.fit_linear(scaler.apply(frame), state.features, "y")
    return R.Scorer(state, scaler, {"linear": fitted}, "linear")


def test_batch_scores(spark, scorer):
    fresh = spark.createDataFrame([(1, 2.0, "u"), (2, 4.0, "w")], "id long, x double, kind string")
    got = {r["id"]: r["prediction"] for r in R.score(fresh, scorer, keep=["id"]).collect()}
    assert got == {1: pytest.approx(10.0, abs=1e-3), 2: pytest.approx(27.0, abs=1e-3)}


def test_stream_equals_batch(spark, scorer, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    fresh = spark.range(50).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit("u").alias("kind"))
    fresh.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(fresh.schema).parquet(source)
    again = str(tmp_path / "progress")
    run = score_stream(stream, scorer, sink, ["id"], again, once=True)
    run.awaitTermination(120)
    got = spark.read.parquet(sink)
    assert got.exceptAll(R.score(fresh, scorer, keep=["id"])).count() == 0
    assert got.count() == 50
    more = spark.range(50, 57).select("id", (F.col("id") % 10).cast("double").alias("x"), F.lit("u").alias("kind"))
    more.write.mode("append").parquet(source)
    for _ in range(2):  # a restart reads the new rows, and only once
        score_stream(stream, scorer, sink, ["id"], again, once=True).awaitTermination(120)
        assert spark.read.parquet(sink).count() == 57
