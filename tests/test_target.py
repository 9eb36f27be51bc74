"""Target ranking on the small known tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions.names import spaced
from tabloom.operators import dependency as D
from tabloom.operators import target as T
from tabloom.operators.profile import profile


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.RandomState(42)
    y = rng.choice([0, 1], size=100)
    x1, x2, sparse = rng.randn(100), rng.randn(100), rng.randn(100)
    rows = [
        (float(x1[i]), float(x2[i]), int(y[i]), int(y[i]), float(sparse[i]) if i < 10 else None, int(y[i]))
        for i in range(100)
    ]
    return spark.createDataFrame(
        rows, "first_col double, feature_two double, target_column int, leaky_col int, sparse_col double, class_label int"
    ).cache()


def signals(table):
    p = profile(table)
    made = T.missingness(T.cardinality_signal(T.position(T.name_match(p), len(table.columns))))
    return {r["name"]: r for r in made.collect()}


@pytest.mark.parametrize(
    ("name", "words"),
    [
        ("targetColumn", "target column"),
        ("target_col", "target col"),
        ("Target-Col", "target col"),
        ("myTargetColumn_Name", "my target column name"),
    ],
)
def test_names_are_spaced(spark, name, words):
    assert spark.range(1).select(spaced(F.lit(name))).first()[0] == words


def test_cheap_signals(table):
    s = signals(table)
    assert 0.5 <= s["class_label"]["name_match"] <= 0.8
    assert 0.5 <= s["target_column"]["name_match"] <= 0.8
    assert s["feature_two"]["name_match"] == 0.0
    assert s["class_label"]["position"] == 1.0
    assert s["first_col"]["position"] == 0.6
    assert 0.6 < s["target_column"]["position"] < 1.0
    assert (s["class_label"]["cardinality"], s["class_label"]["variant"]) == (1.0, "classification")
    assert s["first_col"]["cardinality"] > 0.5 and s["first_col"]["variant"] == "regression"
    assert s["class_label"]["missingness"] == 1.0
    assert s["sparse_col"]["missingness"] == 0.1


def test_keyword_itself_scores_one(spark):
    one = spark.createDataFrame([("label",), ("Target-Class",)], "name string")
    assert [r[0] for r in T.name_match(one).select("name_match").collect()] == [1.0, 1.0]


def test_dependency_gate_and_leak(table):
    assert T.dependency(table, "first_col", "regression", 0.2)[:2] == (0.0, True)
    score, skipped, _ = T.dependency(table, "leaky_col", "classification", 0.5)
    assert score > 0.8 and not skipped


def test_semantic_gate(table):
    p = T.name_match(profile(table))
    found = {r["name"]: r for r in T.semantic(p, {}).collect()}
    assert found["target_column"]["semantic"] == 0.0
    assert found["target_column"]["semantic_skipped"] == "name_match_sufficient"
    assert found["feature_two"]["semantic_skipped"] is None
    assert 0.0 <= found["feature_two"]["semantic"] <= 1.0


def test_ranking_order(table):
    ranked = T.rank_targets(table).collect()
    assert ranked[0]["name"] in ("class_label", "target_column")
    assert len(ranked) == 6 and ranked[0]["score"] >= ranked[-1]["score"]


def numbered(spark, columns, n=30):
    rng = np.random.RandomState(1)
    data = [[float(i) if j == 0 else float(rng.randint(0, 50)) for j in range(len(columns))] for i in range(n)]
    return spark.createDataFrame([tuple(r) for r in data], ", ".join(f"`{c}` double" for c in columns))


@pytest.mark.parametrize(
    ("columns", "expected"),
    [
        (["id", "sqft", "bedrooms", "bathrooms", "zipcode", "price"], "price"),
        (["customer_id", "tenure", "monthly_charges", "total_charges", "churn"], "churn"),
        (["store_id", "date", "is_promo", "revenue"], "revenue"),
        (["col_a", "col_b", "my_target_col", "col_c"], "my_target_col"),
    ],
)
def test_meta_score_finds_the_target(spark, columns, expected):
    assert T.best_meta_target(numbered(spark, columns)) == expected


def test_time_order(spark):
    rows = [(i, f"2024-01-{i:02d}", i % 5) for i in range(1, 29)]
    rising = spark.createDataFrame(rows, "row_id int, day_date string, v int").repartition(5)
    assert T.is_time_ordered(rising, ["row_id"])
    assert T.is_time_ordered(rising, ["row_id"], limit=3, block_rows=4)
    assert not T.is_time_ordered(rising, ["v", "row_id"])


def test_many_classes_and_categories(spark):
    kind = F.col("id") % 150
    df = spark.range(3000).select(
        F.concat(F.lit("c"), kind).alias("kind"), (kind * 10).alias("a"), F.concat(F.lit("t"), F.col("id") % 500).alias("name_text")
    )
    score, skipped, reason = T.dependency(df, "kind", "classification", 1.0)
    assert score > 0.05 and not skipped and reason is None
    slots = D.frequent_slots(df, "name_text", "slot", 128)
    assert slots.select("slot").distinct().count() == 128 and slots.count() == 3000
    # A text of fewer rows than folds cannot be learned from and shares the last slot.
    rare = D.frequent_slots(df.withColumn("name_text", F.expr("uuid()")), "name_text", "slot", 128)
    assert rare.select("slot").distinct().count() == 1
