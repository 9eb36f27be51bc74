"""AdaBoost.R2 and ordered target statistics against plain re-computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.hashing import key_hash
from tabloom.operators import boosting as B
from tabloom.operators import evaluate as V
from tabloom.operators import models as M


def plain_r2(x, y, rounds, rate):
    """AdaBoost.R2 where a tree is the weighted mean per value of x."""
    w, made, weights = np.ones(len(y)), [], []
    for number in range(rounds):
        tree = {v: np.average(y[x == v], weights=w[x == v]) for v in set(x)}
        e = np.abs(y - np.array([tree[v] for v in x]))
        made.append(tree)
        if e.max() == 0:
            weights.append(1.0)
            break
        loss = (w * e).sum() / (e.max() * w.sum())
        if loss >= 0.5:
            if len(made) > 1:
                made.pop()
            else:
                weights.append(1.0)
            break
        beta = loss / (1 - loss)
        weights.append(rate * math.log(1 / beta))
        w = w / w.sum() * beta ** ((1 - e / e.max()) * rate)
    guesses = []
    for v in x:
        order = sorted(range(len(made)), key=lambda i: made[i][v])
        upto = np.cumsum([weights[i] for i in order])
        guesses.append(made[order[int((upto >= sum(weights) / 2 - 1e-12).argmax())]][v])
    return weights, np.array(guesses)


@pytest.mark.parametrize("rounds,rate", [(1, 0.5), (12, 0.5), (8, 1.5)])
def test_adaboost_equals_plain(spark, rounds, rate):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 4, 400).astype(float)
    y = x * 10 + rng.exponential(3, 400) * (x + 1)
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id int, x double, y double")
    fitted = M.fit_adaboost(frame, ["x"], "y", trees=rounds, learning_rate=rate)
    weights, guesses = plain_r2(x, y, rounds, rate)
    np.testing.assert_allclose(fitted.model.weights, weights, rtol=1e-6)
    found = [r["prediction"] for r in fitted.predict(frame).orderBy("id").collect()]
    np.testing.assert_allclose(found, guesses, rtol=1e-6)
    assert M.importance(fitted, frame, "y").first()["importance"] == 1.0


def test_adaboost_stops_when_perfect_and_is_registered(spark):
    frame = spark.range(60).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 3 * 5).cast("double").alias("y"))
    fitted = M.fit_model(frame, ["x"], "y", "adaboost", {"trees": 5})
    assert len(fitted.model.trees) == 1 and fitted.predict(frame).where("prediction <> y").count() == 0
    assert len(M.draws("adaboost")) == 25


@pytest.mark.parametrize("limit", [10**6, 7])
def test_ordered_statistics(spark, limit):
    text = F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 7)))
    frame = spark.range(500).select("id", text.alias("kind"), F.when(F.col("id") % 11 != 0, F.col("id") % 13).alias("y")).repartition(6)
    made, known = B.ordered_statistics(frame, "kind", "y", ["id"], limit=limit, block_rows=20)
    rows = sorted(frame.withColumn("h", key_hash(["id"], "order")).collect(), key=lambda r: (r.h, r.id))
    prior = sum(r.y or 0 for r in rows) / len(rows)
    want, seen = {}, {}
    for r in rows:
        s, n = seen.get(r.kind, (0, 0))
        want[r.id] = (s + prior) / (n + 1)
        seen[r.kind] = (s + (r.y or 0), n + 1)
    assert {r.id: pytest.approx(r.kind_stat) for r in made.collect()} == want
    fresh = spark.createDataFrame([("hot",), (None,), ("new",)], "kind string")
    got = {r.kind: r.kind_stat for r in known.apply(fresh).collect()}
    assert got["new"] == pytest.approx(prior) and got[None] == pytest.approx((seen[None][0] + prior) / (seen[None][1] + 1))
    # A changed target moves later rows of the text only.
    first = rows[0].id
    other = frame.withColumn("y", F.when(F.col("id") == first, 1000).otherwise(F.col("y")))
    again, _ = B.ordered_statistics(other, "kind", "y", ["id"])
    mean = sum(r.y or 0 for r in other.collect()) / len(rows)
    assert {r.id: r.kind_stat for r in again.collect()}[first] == pytest.approx(mean)


def test_catboost_setting_learns_from_texts(spark):
    frame = spark.range(3000).select(
        "id", F.concat(F.lit("c"), F.col("id") % 300).alias("kind"), (F.col("id") % 300 % 17).cast("double").alias("y"), F.rand(2).alias("noise")
    )
    held = F.floor(F.col("id") / 300) % 5 == 0
    train, test = frame.where(~held), frame.where(held)
    fitted = M.fit_model(train, ["kind", "noise"], "y", "catboost", {"trees": 20, "key": ["id"]})
    assert fitted.features == ("kind_stat", "noise") and fitted.statistics[0].column == "kind"
    scored = fitted.predict(test)
    assert scored.columns == [*test.columns, "prediction"]
    assert V.regression_metrics(scored, "y", "prediction").first()["r2"] > 0.6
    assert fitted.predict(test.withColumn("kind", F.lit("new"))).count() == test.count()


def test_catboost_trees_read_cells_of_bins(spark, monkeypatch):
    """Trees over a text's statistic are given one weighted row per bin, and come out as those of the binned rows."""
    n = 4000
    rows = spark.range(n).select(
        "id", F.concat(F.lit("c"), F.col("id") % 3).alias("kind"),
        (F.when(F.col("id") % 17 != 0, F.col("id") % 3 * 10) + F.col("id") % 7).cast("double").alias("y"),
    ).repartition(3)
    given, fit = [], M.GBTRegressor.fit
    monkeypatch.setattr(M.GBTRegressor, "fit", lambda self, frame: given.append(frame) or fit(self, frame))
    fitted = M.fit_boosting(rows, ["kind"], "y", booster="catboost", key=["id"], trees=4, max_depth=5)
    assert given[0].count() <= 32 and given[0].agg(F.sum("_n")).first()[0] == n
    assert len(fitted.cuts["kind_stat"]) <= 31

    known, statistics = B.ordered_statistics(rows, "kind", "y", ["id"])
    cuts = fitted.cuts["kind_stat"]
    bins = F.udf(lambda v: float(sum(v > c for c in cuts)), "double")
    told = known.withColumn("bin", bins("kind_stat")).cache()
    monkeypatch.setattr(M.C, "cells", lambda *_, **__: None)
    plain = M.fit_boosting(told, ["bin"], "y", booster="xgboost", trees=4, max_depth=5)
    assert given[1].count() == n
    fresh = spark.createDataFrame([("c0",), ("c1",), ("c2",), ("new",), (None,)], "kind string")
    quick = fitted.predict(fresh)
    assert quick.columns == ["kind", "prediction"]
    want = plain.predict(statistics.apply(fresh).withColumn("bin", bins("kind_stat")))
    want = {r.kind: pytest.approx(r.prediction, rel=1e-9) for r in want.collect()}
    assert {r.kind: r.prediction for r in quick.collect()} == want


def test_statistics_of_a_large_text_are_put_in_order_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(B, "SORTED_ROWS", 100)
    rows = spark.range(3000).select("id", F.lit("one").alias("kind"), (F.col("id") % 13).alias("y"))
    made, known = B.ordered_statistics(rows, "kind", "y", ["id"], limit=50, block_rows=50)
    held = made.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(held) > 10 and max(r["count"] for r in held) < 600
    ids = [r.id for r in rows.withColumn("h", key_hash(["id"], "order")).orderBy("h", "id").collect()]
    y = np.array([i % 13 for i in ids], float)
    want = (np.concatenate(([0.0], np.cumsum(y)[:-1])) + y.mean()) / np.arange(1, 3001)
    got = {r.id: r.kind_stat for r in made.collect()}
    np.testing.assert_allclose([got[i] for i in ids], want, rtol=1e-9)
    assert known.small


@pytest.mark.parametrize("change", ["nulls", "empty"])
def test_statistics_of_gaps(spark, change):
    rows = spark.createDataFrame([(None, None, None), (None, "a", 2.0), (3, "a", None), (4, None, 6.0)], "id int, kind string, y double")
    rows = rows.where("id > 9") if change == "empty" else rows
    made, known = B.ordered_statistics(rows, "kind", "y", ["id"], limit=1, block_rows=1)
    assert made.columns == ["id", "kind", "y", "kind_stat"] and made.count() == rows.count()
    assert made.where("kind_stat IS NULL").count() == 0 and known.prior == (0.0 if change == "empty" else 2.0)
