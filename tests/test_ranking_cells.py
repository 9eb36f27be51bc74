"""The model-based signal over more rows than its trees should read one by one."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tabloom.operators import dependency as D


def table(spark, n=40_000):
    number = F.pmod(F.xxhash64(F.col("id")), F.lit(2000)) / 100
    return spark.range(n).select(
        number.alias("a"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"),
        F.when(number < 5, "low").when(number < 12, "mid").otherwise("high").alias("kind"),
        (F.pow(number, F.lit(2)) + 10 * (F.col("id") % 7)).alias("y"), F.concat(F.lit("n"), F.col("id")).alias("note"),
    )


@pytest.fixture
def fitted(monkeypatch):
    """Rows that were given to the models."""
    rows = []
    for kind in (RandomForestClassifier, GBTRegressor):
        def fit(self, frame, *rest, plain=kind.fit):
            rows.append(frame.count())
            return plain(self, frame, *rest)

        monkeypatch.setattr(kind, "fit", fit)
    return rows


@pytest.mark.parametrize(("target", "task"), [("kind", "classification"), ("y", "regression")])
def test_trees_read_cells(spark, fitted, monkeypatch, target, task):
    monkeypatch.setattr(D, "MOST_PIECES", 4000)
    df = table(spark).select("a", "text", target, "note")
    score = D.dependency(df, target, task, 1.0, ["note"])[0]
    assert len(fitted) == 3 and max(fitted) < 10_000
    monkeypatch.setattr(D, "BINNED_ROWS", 10**9)
    plain = D.dependency(df, target, task, 1.0, ["note"])[0]
    assert min(fitted[3:]) > 25_000
    assert score > 0.95 and score == pytest.approx(plain, abs=0.02)


def test_rows_that_do_not_repeat_are_all_read(spark, fitted):
    df = table(spark).select("kind", "note", *[F.rand(i).alias(f"r{i}") for i in range(4)], "a")
    assert D.dependency(df, "kind", "classification", 1.0, ["note"])[0] > 0.95
    assert len(fitted) == 3 and min(fitted) > 25_000


def test_bins_keep_few_values_and_order(spark):
    df = spark.range(30_000).select((F.col("id") % 100).cast("double").alias("few"), F.col("id").cast("double").alias("many"))
    made = D._tree_bins(df.withColumn("had", F.col("many")), ["few", "many"])
    assert made.where(F.col("few") != F.col("had") % 100).count() == 0
    spans = made.groupBy("many").agg(F.min("had").alias("low"), F.max("had").alias("high"), F.count("had").alias("n")).orderBy("many").collect()
    assert len(spans) == D.SLOTS and max(r["n"] for r in spans) < 300
    assert all(a["high"] < b["low"] for a, b in zip(spans, spans[1:], strict=False))
