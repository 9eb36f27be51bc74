"""Rows with a null order key or a null series are neither lost nor flagged null."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import explore as X
from tabloom.operators import split as D
from tabloom.operators.quantiles import grouped_median
from tabloom.plans import forecast as G


def rows(spark, nulls):
    at = F.when(F.col("id") >= nulls, F.col("id") * 7 % 101)
    return spark.range(100).select("id", at.alias("t"), F.when(F.col("id") % 9 > 0, F.col("id") % 5).alias("u"))


@pytest.mark.parametrize("nulls", [0, 10, 40, 95, 100])
@pytest.mark.parametrize("order", [["t", "id"], ["u", "t", "id"], ["text", "id"]])
@pytest.mark.parametrize("limit", [7, 10**6])
def test_every_row_is_on_one_side(spark, nulls, order, limit):
    df = rows(spark, nulls).withColumn("text", F.col("t").cast("string"))
    marked = D.split(df, 0.2, "chronological", order_by=order, limit=limit)
    train, test = D.train_test(marked)
    assert (train.count(), test.count()) == (80, 20)
    want = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).collect()[80:]
    assert {r.id for r in test.collect()} == {r.id for r in want}
    folds = D.time_folds(df, 4, order, limit=limit).groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in folds} == {-1: 20, 0: 20, 1: 20, 2: 20, 3: 20}
    assert D.boundary(df, 0.2, order, limit=limit).count() == 6


def test_median_of_null_series_on_both_paths(spark):
    df = spark.range(60).select(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("s"),
        F.lit("2024-01-05").cast("timestamp").alias("t"), F.col("id").cast("double").alias("v"),
    )
    found = [
        sorted(map(str, X.bucket_series(df, "t", ["v"], "month", {"v": "median"}, series=["s"], limit=n).collect()))
        for n in (10**6, 5)
    ]
    assert found[0] == found[1] and "None" not in [r.split("v=")[1] for r in found[1]]


@pytest.mark.parametrize("limit", [3, 50, 10**6])
def test_grouped_median_checks_its_brackets(spark, limit):
    df = spark.range(5000).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"),
        F.when(F.col("id") % 4 == 1, F.col("id") % 2).when(F.col("id") % 4 == 2, F.lit(7)).otherwise(F.col("id") * 7919 % 4099).cast("double").alias("v"),
    )
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {r.g: r.m for r in grouped_median(df, ["g"], F.col("v"), "m", limit).collect()} == want


def test_null_series_are_forecast(spark):
    df = spark.range(60).select(
        F.when(F.col("id") % 2 > 0, F.lit("a")).alias("s"), F.floor(F.col("id") / 2).alias("t"),
        (F.col("id") % 24 * 3 + F.col("id")).cast("double").alias("y"),
    )
    for forecast in (G.forecast_ar, G.forecast_seasonal_ar):
        got = forecast(df, ["s"], ["t"], "y", 3)
        assert {(r.s, r.step) for r in got.collect()} == {(s, i) for s in (None, "a") for i in (1, 2, 3)}
