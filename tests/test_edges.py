"""Edge tables: empty, one row, gaps, constants, NaN, odd names; sources and encodings."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import calendar as K
from tabloom.operators import clean as C
from tabloom.operators import encode as E
from tabloom.operators import explore as X
from tabloom.operators import profile as P
from tabloom.operators import select as S
from tabloom.plans import forecast as G
from tabloom.sources import files, runlog

NAN = float("nan")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, NAN, None, "a.b", 5.0), (2, 2.0, None, "c d", 5.0), (3, 4.0, None, None, 5.0)]
    return spark.createDataFrame(rows, "`row id` int, `x.y` double, gone double, kind string, same double")


def test_profile_of_odd_columns(odd):
    got = {r["name"]: r for r in P.profile(odd).collect()}
    assert (got["x.y"]["nulls"], got["x.y"]["nunique"]) == (1, 2)
    assert (got["gone"]["nulls"], got["gone"]["nunique"]) == (3, 0)
    stats = {r["name"]: r for r in P.numeric_stats(odd).collect()}
    assert stats["gone"]["mean"] == 0.0 and stats["x.y"]["median"] == 3.0


def test_empty_table(spark, odd):
    empty = odd.where("false")
    assert P.shape(empty).first()["n_rows"] == 0
    assert P.cardinality(empty).count() == 5
    assert P.numeric_stats(empty).count() == 4
    assert C.handle_missing(empty, "mean").count() == 0
    assert {r["r"] for r in P.corr_matrix(empty, ["x.y", "same"]).collect()} == {0.0}


def test_correlations_with_constants_and_gaps(odd):
    r = {(x["col_a"], x["col_b"]): x["r"] for x in P.corr_matrix(odd).collect()}
    assert r["same", "same"] == 0.0 and r["row id", "x.y"] == 1.0 and r["gone", "x.y"] == 0.0
    zero = {(x["col_a"], x["col_b"]): x["r"] for x in P.corr_matrix(odd, nulls="zero").collect()}
    assert zero["same", "same"] == 1.0


def test_many_columns_take_the_matrix_path(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(45)])
    wide = {(x["col_a"], x["col_b"]): x["r"] for x in P.corr_matrix(df).collect()}
    few = {(x["col_a"], x["col_b"]): x["r"] for x in P.corr_matrix(df, ["c0", "c5", "c9"]).collect()}
    assert all(abs(wide[k] - v) < 1e-4 for k, v in few.items())


def test_one_hot_with_odd_categories(odd):
    got = E.one_hot(odd, ["kind"]).orderBy("`row id`").collect()
    assert [r["kind_a.b"] for r in got] == [1.0, 0.0, 0.0]
    assert [r["kind_c d"] for r in got] == [0.0, 1.0, 0.0]


def test_too_many_categories_are_refused(spark):
    with pytest.raises(ValueError, match="one_hot_vector"):
        E.learn_categories(spark.range(50).select(F.col("id").cast("string").alias("c")), ["c"], cap=20)


def test_missing_drop_counts_nan(odd):
    assert C.handle_missing(odd.drop("gone"), "drop").count() == 1
    filled = C.handle_missing(odd, "median").orderBy("`row id`").collect()
    assert filled[0]["x.y"] == 3.0 and filled[0]["gone"] is None


def test_calendar_names(spark):
    found = K.detect_calendar(["Fiscal Year", "day_of_week", "weekday_name", "week_no", "qtr", "birthday", "load_date", "timestamp"])
    assert found == {
        "year": "Fiscal Year", "dayofweek": "weekday_name", "week": "week_no", "quarter": "qtr", "day": "birthday",
        "date": "load_date", "timestamp": "timestamp",
    }


def test_aggregate_nulls(spark):
    rows = [("a", None, 1), ("a", None, 2), (None, 3.0, 3), ("b", 4.0, 4)]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    got = {r["k"]: r["v"] for r in K.aggregate(df, ["k"], "sum", {"id": "min"}).collect()}
    assert got == {"a": 0.0, "b": 4.0}


def test_aggregate_median_of_a_hot_group(spark):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        (F.col("id") * 7919 % 3001).cast("double").alias("v"),
    )
    plain = K.aggregate(df, ["k"], "median")
    narrow = K.aggregate(df, ["k"], "median", limit=100)
    assert plain.exceptAll(narrow).count() == 0 and plain.count() == narrow.count()


def test_range_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    series = X.bucket_series(orders, "o_orderdate", ["o_totalprice"], "month", start="1996-02", end="1996-12")
    plan = series._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan
    assert series.count() == 11


def test_breakdown_refuses_too_many_lines(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    with pytest.raises(ValueError):
        X.breakdown(orders, "o_orderdate", ["o_totalprice"], "o_orderpriority", list("abcdefg"))
    assert len(X.breakdown(orders, "o_orderdate", ["o_totalprice"], "o_orderpriority").columns) == 5


def test_mutual_information_of_equal_columns(spark):
    df = spark.range(1000).select((F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 4).cast("string").alias("b"))
    assert abs(S.mutual_information(df, "a", "b").first()[0] - 1.3862943611) < 1e-6


def test_forecasts_of_short_series(spark):
    one = spark.createDataFrame([("s", 1, 50.0)], "s string, t int, y double")
    got = G.forecast_linear(one, ["s"], ["t"], "y", 3).collect()
    assert [r["value"] for r in got] == [50.0] * 3
    assert [r["value"] for r in G.forecast_ar(one, ["s"], ["t"], "y", 2).collect()] == [50.0] * 2
    assert [r["value"] for r in G.forecast_seasonal_ar(one, ["s"], ["t"], "y", 2).collect()] == [50.0] * 2
    with pytest.raises(ValueError):
        G.forecast_exog(one, ["s"], ["t"], "y", [])


def test_seasonal_forecast_repeats_a_pattern(spark):
    rows = [(t, float(t % 12 * 10 + t // 12)) for t in range(60)]
    df = spark.createDataFrame(rows, "t int, y double")
    got = [r["value"] for r in G.forecast_seasonal_ar(df, [], ["t"], "y", 24).orderBy("step").collect()]
    assert got == [pytest.approx(float(t % 12 * 10 + t // 12), abs=1e-6) for t in range(60, 84)]


def write(path, text, encoding):
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1", "utf-16"])
def test_csv_encodings_and_missing_words(spark, tmp_path, encoding):
    text = 'name,count,share,flag,150\nZoë,1,0.5,True,x\nN/A,null,NaN,False,"a, b"\nBär,3,,True,\n'
    df = files.read_csv(spark, write(tmp_path / "t.csv", text, encoding))
    assert dict(df.dtypes) == {"name": "string", "count": "bigint", "share": "double", "flag": "boolean", "150": "string"}
    got = {r["name"]: r for r in df.collect()}
    assert set(got) == {"Zoë", None, "Bär"}
    assert got[None]["count"] is None and got[None]["share"] is None and got[None]["150"] == "a, b"


def test_csv_with_schema(spark, tmp_path):
    df = files.read_csv(spark, write(tmp_path / "s.csv", "a,b\n1,x\nNA,2\n", "utf-8"), "a int, b double")
    assert [(r["a"], r["b"]) for r in df.orderBy(F.col("a").desc()).collect()] == [(1, None), (None, 2.0)]


def test_run_log_order_and_filter(spark, tmp_path):
    path = str(tmp_path / "runs")
    for user, model in (("ann", "m1"), ("bob", "m2"), ("ann", "m3")):
        metrics = spark.createDataFrame([(model, 0.5, None)], "model string, r2 double, error string")
        runlog.append_runs(runlog.run_rows(metrics, "d", "y", 2, {"split": 0.2}, user=user), path)
    assert [r["model_name"] for r in runlog.list_runs(spark, path).collect()] == ["m3", "m2", "m1"]
    mine = runlog.list_runs(spark, path, user="ann")
    assert [r["model_name"] for r in mine.collect()] == ["m3", "m1"]
    one = mine.first()["id"]
    assert runlog.list_runs(spark, path, run_id=one).count() == 1
    assert "EqualTo(user_id,ann)" in mine._jdf.queryExecution().executedPlan().toString()


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n1,"x\ny"\n2,z\n', "utf-8")
    with pytest.raises(ValueError, match="multiline"):
        files.read_csv(spark, path)
    assert {(r["a"], r["b"]) for r in files.read_csv(spark, path, multiline=True).collect()} == {(1, "x\ny"), (2, "z")}
    assert files.read_csv(spark, path, multiline=False).count() == 3
