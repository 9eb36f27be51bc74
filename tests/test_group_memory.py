"""Aggregates of groups that keep one buffer per group in a task, whatever its rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.operators import calendar as K


def rows(spark):
    day = F.when(F.col("id") % 11 > 0, F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("id") * 7 % 97).cast("int")))
    return spark.range(3000).select(
        F.when(F.col("id") % 13 > 0, F.concat(F.lit("k"), F.col("id") % 4)).alias("a.b"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("id") % 3).alias("g"),
        day.alias("day"), F.when(F.col("id") % 3 > 0, F.col("id") % 250).alias("v"), F.when(F.col("id") % 7 > 0, F.col("id") % 90).cast("string").alias("w"),
        F.when(F.col("id") % 4 > 0, F.to_timestamp(F.col("id") * 7 % 97 * 1000)).alias("stamp"), F.lit(None).cast("double").alias("none"),
    )


@pytest.mark.parametrize("how", ["first", "last"])
def test_equals_plain_aggregates(spark, how):
    df = rows(spark)
    some = df.where(F.col("day").isNotNull() | (F.col("stamp").isNull()))
    done = K.aggregate(some, ["a.b", "g"], "mean", {"v": "nunique", "w": "nunique", "none": "nunique", "stamp": how, "day": how}, order_by=["day"])
    place = F.struct("day")
    pick = F.min_by if how == "first" else F.max_by
    want = some.where(F.col("`a.b`").isNotNull() & F.col("g").isNotNull()).groupBy("`a.b`", "g").agg(
        *[pick(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in ("day",)], F.count_distinct("v").alias("v"), F.count_distinct("w").alias("w"),
        pick(F.col("stamp"), F.when(F.col("stamp").isNotNull(), place)).alias("stamp"), F.count_distinct("none").alias("none"),
    )
    assert done.count() == want.count() == 16
    assert done.select(*want.columns[2:]).exceptAll(want.select(*want.columns[2:])).count() == 0


@pytest.mark.parametrize(("how", "want"), [("first", 3.0), ("last", 2.0)])
def test_null_order_keys_come_first(spark, how, want):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", None, 3), ("a", 3, None), ("b", None, 5)], "k string, at int, v int")
    got = {r["k"]: r["v"] for r in K.aggregate(df, ["k"], "max", {"v": how, "at": "max"}, order_by=["at"]).collect()}
    assert got == {"a": want, "b": 5.0}


def test_no_task_sorts_its_rows(spark):
    done = K.aggregate(rows(spark).drop("w"), ["a.b"], "mean", {"v": "nunique"}, order_by=["day"])
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "avg(" in plan
    # The values of the distinct count are no keys of the other aggregates.
    assert not [line for line in plan.splitlines() if "partial_avg" in line and "v#" in line.split("functions=")[0]]
