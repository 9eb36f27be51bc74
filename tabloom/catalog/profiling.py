"""Profiling queries."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import per_column, query, table
from tabloom.operators import distinct as U
from tabloom.operators import profile as P
from tabloom.operators.quantiles import quantiles
from tabloom.session import scratch_path

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]

# Orders with gaps: the test tables hold no nulls, so both sides derive some.
ORDERS_GAPS_SQL = """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders"""

LINE_GAPS_SQL = """SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber END AS l_linenumber,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem"""


def orders_gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.withColumns(
        {
            "o_orderstatus": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")),
            "o_totalprice": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")),
        }
    )


def line_gaps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.withColumns(
        {
            "l_linenumber": F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")),
            "l_tax": F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax")),
        }
    )


@query("table_shape", "SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_cols, 8::BIGINT AS n_numeric FROM lineitem")
def table_shape(spark, sf_dir):
    return P.shape(table(spark, sf_dir, "lineitem"))


@query(
    "column_types",
    """SELECT name, pos, type, filled FROM (
    SELECT 'event_id' AS name, 0::BIGINT AS pos, 'numeric' AS type, count(event_id)::BIGINT AS filled FROM events
    UNION ALL SELECT 'ts', 1, 'datetime', count(ts) FROM events
    UNION ALL SELECT 'user_id', 2, 'numeric', count(user_id) FROM events
    UNION ALL SELECT 'event_type', 3, 'categorical', count(event_type) FROM events
    UNION ALL SELECT 'value', 4, 'numeric', count(value) FROM events
    UNION ALL SELECT 'props', 5, 'categorical', count(props) FROM events
    UNION ALL SELECT 'day', 6, 'datetime', count(*) FROM events)""",
)
def column_types(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return P.column_types(events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")))


@query(
    "column_cardinality",
    "WITH t AS (" + ORDERS_GAPS_SQL + ") "
    + per_column(
        ORDERS,
        "SELECT '{c}' AS name, count(DISTINCT {c})::BIGINT AS cardinality,"
        " round(100.0 * (count(*) - count({c})) / count(*), 1)::DOUBLE AS null_pct FROM t",
    ),
)
def column_cardinality(spark, sf_dir):
    return P.cardinality(orders_gaps(spark, sf_dir))


@query(
    "sample_values",
    "WITH u AS ("
    + per_column(
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
        "SELECT DISTINCT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM part",
    )
    + "), r AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY value) AS place, value FROM u)"
    " SELECT name, place::BIGINT AS place, value FROM r WHERE place <= 8",
)
def sample_values(spark, sf_dir):
    return P.sample_values(table(spark, sf_dir, "part").drop("p_retailprice"))


@query(
    "numeric_stats",
    "WITH t AS (" + LINE_GAPS_SQL + ") "
    + per_column(
        LINE_NUMERIC,
        "SELECT '{c}' AS name, round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4)::DOUBLE AS median,"
        " round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min, round(max({c}), 4)::DOUBLE AS max FROM t",
    ),
)
def numeric_stats(spark, sf_dir):
    return P.numeric_stats(line_gaps(spark, sf_dir))


@query(
    "datetime_stats",
    """SELECT 'o_orderdate' AS name, strftime(min(o_orderdate), '%Y-%m-%d') AS min,
      strftime(max(o_orderdate), '%Y-%m-%d') AS max FROM orders
    UNION ALL SELECT 'text_date', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d')
      FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'o_orderpriority', '', '' """,
)
def datetime_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return P.datetime_stats(o.withColumn("text_date", text), ["o_orderdate", "text_date", "o_orderpriority"])


@query(
    "categorical_stats",
    """WITH u AS (SELECT 'c_name' AS name, c_name AS value, count(*) AS n FROM customer GROUP BY c_name
      UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment)
    SELECT name, value, n::BIGINT AS n,
      row_number() OVER (PARTITION BY name ORDER BY n DESC, value) = 1 AS is_mode FROM u""",
)
def categorical_stats(spark, sf_dir):
    return P.categorical_stats(table(spark, sf_dir, "customer"))


def corr_sql(source: str, cols: list[str], wrap: str, diagonal_one: bool) -> str:
    parts = []
    for a in cols:
        for b in cols:
            va, vb = wrap.format(c=a), wrap.format(c=b)
            r = "1.0::DOUBLE" if diagonal_one and a == b else f"round(coalesce(CASE WHEN isnan(corr({va}, {vb})) THEN 0 ELSE corr({va}, {vb}) END, 0), 4)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r} AS r FROM t")
    return f"WITH t AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS constant FROM ({source})) " + "\nUNION ALL ".join(parts)


@query("corr_matrix", corr_sql(LINE_GAPS_SQL, [*LINE_NUMERIC, "constant"], "{c}", False))
def corr_matrix(spark, sf_dir):
    df = line_gaps(spark, sf_dir).withColumn("constant", F.lit(1.0))
    return P.corr_matrix(df)


@query(
    "corr_matrix_zero_filled",
    "WITH z AS ("
    + corr_sql(LINE_GAPS_SQL, LINE_NUMERIC, "coalesce({c}, 0)", False)
    + ") SELECT col_a, col_b, CASE WHEN col_a = col_b THEN 1.0 ELSE r END::DOUBLE AS r FROM z",
)
def corr_matrix_zero_filled(spark, sf_dir):
    return P.corr_matrix(line_gaps(spark, sf_dir), nulls="zero")


@query(
    "top_values",
    """SELECT trim(p_name) AS value, count(*)::BIGINT AS n FROM part WHERE trim(p_name) <> ''
    GROUP BY 1 ORDER BY n DESC, value LIMIT 20""",
)
def top_values(spark, sf_dir):
    return P.top_values(table(spark, sf_dir, "part"), "p_name")


@query(
    "row_search",
    "SELECT * FROM customer WHERE "
    + " OR ".join(
        f"contains(lower(CAST({c} AS VARCHAR)), 'machi') "
        for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    ),
)
def row_search(spark, sf_dir):
    return P.search(table(spark, sf_dir, "customer"), "MACHI")


@query("row_sort", "SELECT * FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def row_sort(spark, sf_dir):
    return P.sort_rows(table(spark, sf_dir, "customer"), "c_acctbal", desc=True, key=["c_custkey"])


QUANTILE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]


@query(
    "column_quantiles",
    per_column(
        QUANTILE_COLUMNS,
        "SELECT '{c}' AS name, "
        + ", ".join(f"round(quantile_cont({{c}}, {p}), 4)::DOUBLE AS {n}" for n, p in (("q01", 0.01), ("q25", 0.25), ("median", 0.5), ("q99", 0.99)))
        + " FROM lineitem",
    ),
)
def column_quantiles(spark, sf_dir):
    """Exact quantiles of six columns at once, read digit by digit beyond 1,000 values."""
    li = table(spark, sf_dir, "lineitem")
    found = quantiles(li, {c: F.col(c) for c in QUANTILE_COLUMNS}, [0.01, 0.25, 0.5, 0.99], limit=1000)
    rows = [(c, *[round(v, 4) for v in found[c]]) for c in QUANTILE_COLUMNS]
    return spark.createDataFrame(rows, "name string, q01 double, q25 double, median double, q99 double")


@query(
    "distinct_sketches",
    per_column(ORDERS, "SELECT '{c}' AS name, count(DISTINCT {c})::BIGINT AS exact, true AS near, true AS merged FROM orders"),
)
def distinct_sketches(spark, sf_dir):
    """Sketches per year of orders, stored, read again and merged, beside the exact counts."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    path = scratch_path(spark, "sketches")
    U.distinct_sketches(orders, ORDERS, rsd=0.01, by=["year"]).write.parquet(path)
    parts = spark.read.parquet(path)
    found = U.estimates(U.merge_sketches(parts)).withColumnRenamed("nunique", "guess")
    exact = U.distinct_counts(orders, ORDERS).select("name", F.col("nunique").alias("exact"))
    near = F.abs(F.col("guess") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    sizes = parts.groupBy("name").agg(F.count(F.lit(1)).alias("parts"))
    return exact.join(found, "name").join(sizes, "name").select("name", "exact", near.alias("near"), (F.col("parts") > 1).alias("merged"))
