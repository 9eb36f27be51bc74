"""Distinct counts of all columns, exact and by sketches."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import distinct as U
from tabloom.operators import profile as P
from tabloom.operators import quality as Q
from tabloom.operators import select as S


@pytest.fixture(scope="module")
def table(spark):
    nan = float("nan")
    number = F.when(F.col("id") % 5 == 0, F.lit(nan)).when(F.col("id") % 5 == 1, F.lit(0.0)).when(F.col("id") % 5 == 2, F.lit(-0.0))
    return spark.range(0, 5000, 1, 6).select(
        "id", (F.col("id") % 700).cast("string").alias("text"), number.otherwise(F.col("id") % 11 + 0.5).alias("number"),
        F.lit(None).cast("int").alias("none"), F.array(F.col("id") % 3).alias("list"), (F.col("id") % 2 == 0).alias("flag"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("day"),
    )


WANT = {"id": 5000, "text": 700, "number": 12, "list": 3, "flag": 2, "day": 400}


def test_exact_counts(table):
    found = {r["name"]: r["nunique"] for r in U.distinct_counts(table).collect()}
    assert found == WANT
    assert {r["name"]: r["nunique"] for r in P.profile(table).collect()} == {**WANT, "none": 0}
    assert U.distinct_counts(table.where("false")).count() == 0


def test_no_row_per_column_is_shuffled_raw(table):
    plan = P.profile(table)._jdf.queryExecution().toString()
    assert "Expand" not in plan
    # The pairs are combined before they move.
    assert plan.index("partial_count") > 0 or "HashAggregate" in plan


def test_sketches_merge(spark, table, tmp_path):
    marked = table.withColumn("part", F.col("id") % 4)
    path = str(tmp_path / "sketches")
    U.distinct_sketches(marked, list(WANT), rsd=0.01, by=["part"]).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 * len(WANT)
    merged = U.merge_sketches(stored)
    for r in U.estimates(merged).collect():
        assert r["nunique"] == pytest.approx(WANT[r["name"]], rel=0.04, abs=0.5)
    # Stored sketches serve the profile, the quality measures and the default features.
    assert {r["name"]: r["nunique"] for r in P.profile(table, sketches=merged).collect()}["flag"] == 2
    ratios = {r["name"]: r["cardinality_ratio"] for r in Q.quality_measures(table.drop("list"), "day", sketches=merged).collect()}
    assert ratios["text"] == pytest.approx(0.14, rel=0.04)
    exact = {r["feature"] for r in S.default_features(table.drop("list"), "number", "b").collect()}
    assert {r["feature"] for r in S.default_features(table.drop("list"), "number", "b", approx=True).collect()} == exact


def test_smallest_values_leave_a_task_only_n_at_a_time(table):
    found = P.sample_values(table, 3)
    rows = {}
    for r in found.orderBy("name", "place").collect():
        rows.setdefault(r["name"], []).append(r["value"])
    assert rows["id"] == ["0", "1", "10"] and rows["flag"] == ["false", "true"] and rows["text"] == ["0", "1", "10"]
    assert "none" not in rows and rows["number"] == ["-0.0", "0.0", "0.5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("MapInArrow") > plan.rindex("Exchange")
