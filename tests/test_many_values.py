"""One-hot encoding of columns with many values."""

import pytest
from pyspark.sql import functions as F

from tabloom.functions.vectors import is_vector, vector_slots
from tabloom.operators import encode as E
from tabloom.operators import models as M
from tabloom.plans import prepare as P
from tabloom.plans import train as T
from tabloom.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def shops(spark):
    """Ten rows for each of 300 shops; the price is ten times the shop's number."""
    made = spark.range(3000).select(
        "id", F.format_string("shop %03d", F.col("id") % 300).alias("shop"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"),
    )
    return made.withColumn("price", (F.col("id") % 300 * 10).cast("double"))


def config(**more):
    return P.PrepareConfig(target="price", features=("x", "shop", "kind"), onehot_columns=("shop", "kind"), row_key=("id",), **more)


def test_no_cap_and_order_of_features(shops):
    frame, state = P.fit_prepare(shops, config())
    assert state.features == ("x", "kind_a", "kind_b", "shop_onehot") and state.categories == {"kind": ["a", "b"]}
    assert state.dictionaries["shop"].size == 300 and is_vector(frame.schema["shop_onehot"].dataType)
    slots = frame.select("id", F.get(vector_slots(F.col("shop_onehot")), 0).alias("s"))
    assert slots.where("s <> id % 300").count() == 0


def test_201_values_pass(spark):
    df = spark.range(201).select("id", F.col("id").cast("string").alias("c"), F.col("id").cast("double").alias("y"))
    _, state = P.fit_prepare(df, P.PrepareConfig(target="y", features=("c",), onehot_columns=("c",), row_key=("id",)))
    assert state.features == ("c_onehot",) and state.dictionaries["c"].size == 201


def test_both_forms_give_one_model(shops):
    wide, state = P.fit_prepare(shops, config())
    flat, plain = P.fit_prepare(shops, config(widest_onehot=400))
    assert len(plain.features) == 303 and not plain.dictionaries
    a = M.fit_ridge(wide, state.features, "price", 0.5).predict(wide).select("id", F.round("prediction", 4).alias("p"))
    b = M.fit_ridge(flat, plain.features, "price", 0.5).predict(flat).select("id", F.round("prediction", 4).alias("q"))
    assert a.join(b, "id").where("abs(p - q) > 0.02").count() == 0


def test_new_rows_unseen_null_missing(spark, shops):
    _, state = P.fit_prepare(shops, config())
    fresh = spark.createDataFrame([(1, "shop 005"), (2, "elsewhere"), (3, None)], "id int, shop string")
    rows = P.apply_prepare(fresh, state, keep=["id"]).select("id", vector_slots(F.col("shop_onehot")).alias("s"), "x", "kind_a")
    # A null takes the most frequent training value, the first of equally frequent ones.
    assert {r.id: list(r.s) for r in rows.collect()} == {1: [5], 2: [], 3: [0]}
    bare = P.apply_prepare(fresh.select("id"), state, keep=["id"]).select(vector_slots(F.col("shop_onehot")).alias("s"))
    assert [list(r.s) for r in bare.collect()] == [[0]] * 3


def test_dictionary_values_stay_off_the_driver(spark, shops):
    made = E.learn_dictionary(shops.unionByName(shops.withColumn("shop", F.lit(None).cast("string"))), "shop")
    assert made.size == 300
    assert [(r.value, r.slot) for r in made.table.orderBy("slot").limit(2).collect()] == [("shop 000", 0), ("shop 001", 1)]
    empty = E.learn_dictionary(shops.where("false"), "shop")
    assert empty.size == 0 and E.one_hot_vector(shops.limit(3), empty).count() == 3


def test_a_whole_run_and_a_stream(spark, shops, tmp_path):
    run = T.train(shops, T.TrainConfig(config(), models=("linear", "ridge"), scaling="zscore"))
    assert "shop_onehot" in run.features
    best = run.trained.metrics.where("is_best").first()
    assert best["error"] is None and best["r2"] > 0.99
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    shops.limit(40).drop("price").write.parquet(source)
    stream = spark.readStream.schema(shops.drop("price").schema).parquet(source)
    score_stream(stream, run.scorer, sink, ["id"], str(tmp_path / "progress"), once=True).awaitTermination(120)
    assert spark.read.parquet(sink).count() == 40
