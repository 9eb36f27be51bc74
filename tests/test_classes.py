"""The model-based signal with more classes and texts than trees tell apart."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import target as T


def planted(spark, classes, rows):
    """``rows`` rows of every class; a text and a number that stand for the class, and noise."""
    kind = F.col("id") % classes
    return spark.range(classes * rows).select(
        F.concat(F.lit("c"), kind).alias("kind"), F.md5(kind.cast("string")).alias("code"), (kind * 7 % classes).cast("double").alias("number"),
        F.rand(1).alias("noise"), F.concat(F.lit("v"), F.col("id")).alias("text"), F.concat(F.lit("w"), F.col("id") % 5).alias("few"),
    )


@pytest.mark.parametrize("classes", [3, 100, 150, 10_000])
def test_any_number_of_classes(spark, classes):
    rows = 12 if classes > 200 else 40
    df = planted(spark, classes, rows)
    score, skipped, reason = T.dependency(df.select("kind", "code", "noise", "text", "few"), "kind", "classification", 1.0)
    assert score > 0.98 and not skipped and reason is None
    blind, _, _ = T.dependency(df.select("kind", "noise", "text"), "kind", "classification", 1.0)
    assert blind < (0.45 if classes == 3 else 0.05)


def test_numbers_tell_rare_classes_too(spark):
    df = planted(spark, 2000, 12)
    assert T.dependency(df.select("kind", "number", "noise"), "kind", "classification", 1.0)[0] > 0.98


def test_merged_classes_are_no_hits(spark):
    df = spark.range(6000).select(
        F.concat(F.lit("c"), F.col("id") % 3000).alias("kind"), F.rand(1).alias("a"),
    )
    score, skipped, _ = T.dependency(df, "kind", "classification", 1.0)
    assert score < 0.05 and not skipped


def test_texts_of_many_values_tell_numbers(spark):
    """Each text has its own number, without order: only the mean per text tells it."""
    df = spark.range(20_000).select(
        F.md5((F.col("id") % 1000).cast("string")).alias("text"), F.pmod(F.xxhash64(F.col("id") % 1000), F.lit(1000)).cast("double").alias("y"),
        F.rand(3).alias("noise"),
    )
    assert T.dependency(df, "y", "regression", 1.0)[0] > 0.9
    assert T.dependency(df.withColumn("text", F.md5(F.rand(4).cast("string"))), "y", "regression", 1.0)[0] < 0.05


def test_a_row_is_not_told_by_itself(spark):
    """Texts that occur once carry the class of their own row only; nothing can be learned from them."""
    df = spark.range(4000).select(
        F.concat(F.lit("v"), F.col("id")).alias("text"), F.when(F.rand(5) < 0.5, "a").otherwise("b").alias("kind")
    )
    assert T.dependency(df, "kind", "classification", 1.0)[0] < 0.56


def test_nulls_and_few_rows(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("t"), F.col("id") % 2)).alias("text"),
        F.when(F.col("id") % 7 != 0, F.when(F.col("id") % 3 == 0, "none").otherwise(F.concat(F.lit("k"), F.col("id") % 2))).alias("kind"),
        F.rand(2).alias("noise"),
    )
    assert T.dependency(df, "kind", "classification", 1.0)[0] == 1.0
    assert T.dependency(df.limit(9), "kind", "classification", 1.0) == (0.0, False, None)
    one = df.withColumn("kind", F.lit("same"))
    assert T.dependency(one, "kind", "classification", 1.0)[0] == 0.0
