"""Ordered windows, numbering and exact quantiles: large-data paths against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import lags as L
from tabloom.operators import quality as Q
from tabloom.operators import split as D
from tabloom.operators.ordered import Ordered, number_rows
from tabloom.operators.quantiles import after_key, grouped_median, keys_at_ranks, order_statistics, quantiles


@pytest.fixture(scope="module")
def rows(spark):
    """A hot series with two thirds of the rows, many ties in time, gaps in the values."""
    rng = random.Random(7)
    data = []
    for i in range(1500):
        series = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.3 else float(rng.randint(0, 40))
        data.append((i, series, rng.randint(0, 60), value))
    return spark.createDataFrame(data, "id long, series string, t int, v double").repartition(7).cache()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_number_rows_is_dense_and_ordered(rows):
    got = [(r["t"], r["id"]) for r in number_rows(rows, ["t", "id"]).orderBy("_rn").collect()]
    assert got == sorted(got)
    assert {r["_rn"] for r in number_rows(rows, ["t", "id"]).collect()} == set(range(1, 1501))


def test_blocked_windows_equal_plain_windows(rows):
    def run(limit, block):
        o = Ordered(rows, ["t", "id"], ["series"], limit, block)
        assert o.blocked == (limit < 100)
        o.look_back(5, lambda w: {"l1": F.lag("v", 1).over(w), "l5": F.lag("v", 5).over(w)})
        o.fill("v", "before", True).fill("v", "after", False)
        o.with_columns({"flag": (F.col("id") % 3).cast("int")}).running_sum("flag", "sum")
        return o.rows()

    plain = run(10**9, 100)
    assert same(plain, run(10, 64))
    assert same(plain, run(10, 7))


def test_blocked_plan_has_no_unpartitioned_window(rows):
    o = Ordered(rows, ["t", "id"], [], 10, 64)
    o.look_back(1, lambda w: {"l1": F.lag("v", 1).over(w)})
    plan = o.rows()._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_lag_features_blocked_equal_plain(rows):
    make = lambda limit: L.lag_features(rows, "v", ["t", "id"], ["series"], 12, limit=limit, block_rows=40)
    assert same(make(10**9), make(5))


def test_runs_blocked_equal_plain_and_brute_force(rows):
    plain = Q.null_runs(rows, "v", ["t", "id"], 2)
    assert same(plain, Q.null_runs(rows, "v", ["t", "id"], 2, limit=5, block_rows=9))
    data = sorted((r["t"], r["id"], r["v"]) for r in rows.collect())
    want, run = [], []
    for t, i, v in [*data, (None, None, 0.0)]:
        if v is None:
            run.append((t, i))
        else:
            if len(run) >= 2:
                want.append((*run[0], *run[-1], len(run)))
            run = []
    got = [(r["first_t"], r["first_id"], r["last_t"], r["last_id"], r["length"]) for r in plain.collect()]
    assert sorted(got) == sorted(want)


def test_flat_runs_by_series_brute_force(rows):
    coarse = rows.withColumn("c", F.floor(F.col("v") / 20))
    got = Q.flat_runs(coarse, "c", ["t", "id"], 3, ["series"], limit=5, block_rows=11)
    by_series = {}
    for r in coarse.orderBy("t", "id").collect():
        by_series.setdefault(r["series"], []).append(r["c"])
    want = []
    for series, values in by_series.items():
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                if values[start] is not None and i - start >= 3:
                    want.append((series or "", i - start, values[start]))
                start = i
    assert sorted((r["series"] or "", r["length"], r["value"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("limit", [10**6, 20, 1])
def test_order_statistics(rows, limit):
    values = sorted(r["v"] for r in rows.where("v is not null").collect())
    ranks = [0, 1, len(values) // 3, len(values) // 2, len(values) - 1]
    assert order_statistics(rows, F.col("v"), ranks, limit) == [values[r] for r in ranks]


@pytest.mark.parametrize("limit", [10**6, 25])
def test_quantiles_match_numpy(rows, limit):
    frame = rows.withColumn("w", F.col("id") * 1.5)
    got = quantiles(frame, {"v": F.col("v"), "w": F.col("w")}, [0.0, 0.1, 0.5, 0.9, 1.0], limit)
    for name in ("v", "w"):
        values = [r[name] for r in frame.collect() if r[name] is not None]
        assert np.allclose(got[name], np.quantile(values, [0.0, 0.1, 0.5, 0.9, 1.0]))


def jobs_of(spark, work):
    """How many Spark jobs a piece of work starts."""
    tag = "count-jobs"
    spark.sparkContext.setJobGroup(tag, tag)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag)) - before


def test_jobs_do_not_grow_with_columns(spark):
    df = spark.range(0, 20_000, 1, 4).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10**9)).cast("double").alias(f"c{i}") for i in range(12)])
    df = df.cache()
    df.count()
    probs = [0.1, 0.5, 0.9]
    few = jobs_of(spark, lambda: quantiles(df, {"c0": F.col("c0")}, probs, 300))
    many = jobs_of(spark, lambda: quantiles(df, {c: F.col(c) for c in df.columns}, probs, 300))
    assert 0 < few and many <= few + 3
    got = quantiles(df, {c: F.col(c) for c in df.columns}, probs, 300)
    values = df.toPandas()
    for c in df.columns:
        assert np.allclose(got[c], np.quantile(values[c], probs))


@pytest.mark.parametrize("limit", [3, 50])
def test_few_values_that_many_rows_share(spark, limit):
    """The rank lies where one crowded value ends and the next begins."""
    df = spark.range(2000).select(F.when(F.col("id") < 1000, 5.0).otherwise(6.0).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    got = quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.25, 0.5, 1 / 3, 0.75], limit)
    assert got["a"] == [5.0, 5.5, 5.0, 6.0]
    assert np.allclose(got["b"], np.quantile(np.arange(2000) % 3, [0.25, 0.5, 1 / 3, 0.75]))


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert quantiles(empty, {"v": F.col("v")}, [0.5]) == {"v": [None]}


@pytest.mark.parametrize("limit", [10**6, 30])
def test_grouped_median(rows, limit):
    got = {r["series"]: r["m"] for r in grouped_median(rows, ["series"], F.col("v"), "m", limit).collect()}
    by_series = {}
    for r in rows.collect():
        if r["v"] is not None:
            by_series.setdefault(r["series"], []).append(r["v"])
    assert got == {k: float(np.median(v)) for k, v in by_series.items()}


@pytest.mark.parametrize("limit", [10**6, 10])
def test_keys_at_ranks_with_ties(rows, limit):
    data = sorted((r["t"], r["id"]) for r in rows.collect())
    ranks = [0, 10, 700, 701, 1499]
    keys = keys_at_ranks(rows, ["t", "id"], ranks, limit)
    assert keys == [data[r] for r in ranks]
    assert rows.where(after_key(["t", "id"], keys[2])).count() == 1500 - 701


@pytest.mark.parametrize("order", [["t", "id"], ["series", "t", "id"]])
def test_chronological_split_and_folds(rows, order):
    frame = rows.where("series is not null")
    n = frame.count()
    data = sorted(tuple(r[c] for c in order) for r in frame.collect())
    held = {tuple(r[c] for c in order) for r in D.split(frame, 0.2, "chronological", order_by=order).where("is_test").collect()}
    assert held == set(data[n - -(-n // 5) :])
    folds = {tuple(r[c] for c in order): r["fold"] for r in D.time_folds(frame, 4, order).collect()}
    size = n // 5
    assert [folds[k] for k in data] == [-1] * (n - 4 * size) + [f for f in range(4) for _ in range(size)]


def test_results_do_not_depend_on_partitions(rows):
    one, many = rows.coalesce(1), rows.repartition(16)
    assert same(D.split(one, 0.2, "random", key=["id"]), D.split(many, 0.2, "random", key=["id"]))
    assert same(L.lag_features(one, "v", ["t", "id"]), L.lag_features(many, "v", ["t", "id"]))
