"""Time buckets, lags, splits and folds."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import query, table
from tabloom.operators import explore as X
from tabloom.operators import lags as L
from tabloom.operators import split as D

# Amounts in another currency. Means of two-digit prices often end in an exact 5, which the two
# engines round differently; converted amounts do not.
RATE = 0.8731234567

# Monthly totals per order status: the series most time queries work on.
MONTHLY_SQL = f"""SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS label,
  (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS sort_key, sum(o_totalprice * {RATE}::DOUBLE) AS o_totalprice
  FROM orders GROUP BY ALL"""


def monthly(spark, sf_dir, series=("o_orderstatus",), how="sum"):
    o = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice") * RATE)
    return X.bucket_series(o, "o_orderdate", ["o_totalprice"], "month", {"o_totalprice": how}, series=series)


@query(
    "time_bucket_series",
    """SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label,
      (year(o_orderdate) * 10 + quarter(o_orderdate))::BIGINT AS sort_key,
      round(sum(o_totalprice), 2) AS o_totalprice, round(quantile_cont(o_custkey, 0.5), 4)::DOUBLE AS o_custkey,
      arg_max(o_orderkey, (o_orderdate, o_orderkey))::DOUBLE AS o_orderkey
    FROM orders WHERE o_orderdate >= DATE '1996-04-01' AND o_orderdate < DATE '2000-10-01' GROUP BY 1, 2""",
)
def time_bucket_series(spark, sf_dir):
    done = X.bucket_series(
        table(spark, sf_dir, "orders"),
        "o_orderdate",
        ["o_totalprice", "o_custkey", "o_orderkey"],
        "quarter",
        {"o_totalprice": "sum", "o_custkey": "median", "o_orderkey": "latest"},
        start="1996-Q2",
        end="2000-Q3",
        order_by=["o_orderdate", "o_orderkey"],
    )
    return done.withColumns({"o_totalprice": F.round("o_totalprice", 2), "o_custkey": F.round("o_custkey", 4)})


@query(
    "time_bucket_series_text",
    """SELECT CAST(year(o_orderdate) AS VARCHAR) AS label, year(o_orderdate)::BIGINT AS sort_key,
      round(avg(o_totalprice), 4) AS o_totalprice, count(o_custkey)::DOUBLE AS o_custkey,
      min(o_orderkey)::DOUBLE AS o_orderkey FROM orders GROUP BY 1, 2""",
)
def time_bucket_series_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("when", F.date_format("o_orderdate", "dd/MM/yyyy"))
    done = X.bucket_series(
        o, "when", ["o_totalprice", "o_custkey", "o_orderkey"], "year", {"o_custkey": "count", "o_orderkey": "min"}
    )
    return done.withColumn("o_totalprice", F.round("o_totalprice", 4))


def _breakdown_sql():
    values = ["1-URGENT", "2-HIGH", "5-LOW"]
    cols = ", ".join(
        f"round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '{v}'), 2) AS \"o_totalprice — {v}\"" for v in values
    )
    return f"""SELECT strftime(o_orderdate, '%Y-%m') AS label,
      (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS sort_key, {cols} FROM orders GROUP BY 1, 2"""


@query("category_breakdown", _breakdown_sql())
def category_breakdown(spark, sf_dir):
    done = X.breakdown(
        table(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice"], "o_orderpriority",
        ["1-URGENT", "2-HIGH", "5-LOW"], "month", {"o_totalprice": "sum"},
    )
    return done.select("label", "sort_key", *[F.round(F.col(f"`{c}`"), 2).alias(c) for c in done.columns[2:]])


@query(
    "xy_series",
    """SELECT 'Row ' || row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS label,
      CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS "o_totalprice — F" FROM orders""",
)
def xy_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return X.xy_series(o, None, ["o_totalprice"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "F")


@query(
    "xy_series_by_column",
    "SELECT CAST(p_size AS VARCHAR) AS label, p_retailprice FROM part ORDER BY p_size, p_partkey",
)
def xy_series_by_column(spark, sf_dir):
    return X.xy_series(table(spark, sf_dir, "part"), "p_size", ["p_retailprice"], ["p_partkey"])


LAG_EXPR = {
    "target_lag_1": "lag(y, 1) OVER w",
    "target_lag_yoy": "lag(y, 12) OVER w",
    "target_yoy_growth": "(lag(y, 1) OVER w - lag(y, 13) OVER w) / (lag(y, 13) OVER w + 1e-8)",
    "target_rolling_mean_3": "avg(y) OVER (PARTITION BY o_orderstatus ORDER BY sort_key ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
    "target_rolling_mean_yoy": "avg(y) OVER (PARTITION BY o_orderstatus ORDER BY sort_key ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)",
}


def lag_sql(columns) -> str:
    raw = ", ".join(f"{LAG_EXPR[c]} AS {c}" for c in columns)
    back = "OVER (PARTITION BY o_orderstatus ORDER BY sort_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    done = ", ".join(
        f"round(coalesce({c}, 0), 4) AS {c}" if c == "target_yoy_growth"
        else f"round(coalesce(first_value({c} IGNORE NULLS) {back}, 0), 2) AS {c}"
        for c in columns
    )
    return f"""WITH m AS (SELECT o_orderstatus, label, sort_key, o_totalprice AS y FROM ({MONTHLY_SQL})),
    raw AS (SELECT o_orderstatus, label, sort_key, {raw} FROM m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY sort_key))
    SELECT o_orderstatus, label, {done} FROM raw"""


def lag_query(name, column):
    @query(name, lag_sql([column]))
    def run(spark, sf_dir):
        done = L.lag_features(
            monthly(spark, sf_dir), "o_totalprice", ["sort_key"], ["o_orderstatus"], columns=[column],
            largest=L.MONTH_SERIES_BOUND,
        )
        digits = 4 if column == "target_yoy_growth" else 2
        return done.select("o_orderstatus", "label", F.round(column, digits).alias(column))


for _name, _column in {
    "target_lag_1": "target_lag_1",
    "target_lag_yoy": "target_lag_yoy",
    "target_yoy_growth": "target_yoy_growth",
    "target_rolling_mean_3": "target_rolling_mean_3",
    "target_rolling_mean_yoy": "target_rolling_mean_yoy",
}.items():
    lag_query(_name, _column)


@query(
    "lag_raw_rows",
    """SELECT o_orderkey, coalesce(lag(o_totalprice, 1) OVER w, 0) AS target_lag_1,
      coalesce(lag(o_totalprice, 12) OVER w, 0) AS target_lag_yoy FROM orders
    WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)""",
)
def lag_raw_rows(spark, sf_dir):
    """Lags over single orders: a few long series, so the blocked windows are used."""
    done = L.lag_features(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"),
        "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_orderstatus"], backfill=False, columns=["target_lag_1", "target_lag_yoy"], limit=4_000, block_rows=4_000,
    )
    return done.select("o_orderkey", "target_lag_1", "target_lag_yoy")


@query(
    "lag_training_averages",
    "SELECT "
    + ", ".join(
        f"round(avg({c}), {4 if c == 'target_yoy_growth' else 1}) AS {c.removeprefix('target_')}" for c in LAG_EXPR
    )
    + " FROM ("
    + lag_sql(list(LAG_EXPR)).replace(", 2) AS", ", 6) AS").replace(", 4) AS", ", 8) AS")
    + ")",
)
def lag_training_averages(spark, sf_dir):
    done = L.lag_features(
        monthly(spark, sf_dir), "o_totalprice", ["sort_key"], ["o_orderstatus"], largest=L.MONTH_SERIES_BOUND
    )
    means = L.lag_means(done)
    return means.select(*[F.round(c, 4 if c == "yoy_growth" else 1).alias(c) for c in means.columns])


HASH = "CAST('0x' || substr(md5(CAST({key} AS VARCHAR){salt}), 1, 8) AS BIGINT)"


def hash_sql(key: str, salt: str = "") -> str:
    return HASH.format(key=key, salt=f" || '#{salt}'" if salt else "")


@query("split_random", f"SELECT o_orderkey, {hash_sql('o_orderkey')} % 100 < 20 AS is_test FROM orders")
def split_random(spark, sf_dir):
    return D.split(table(spark, sf_dir, "orders").select("o_orderkey"), 0.2, "random", key=["o_orderkey"])


@query(
    "split_chronological",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey)
      > count(*) OVER () - ceil(count(*) OVER () * 0.2) AS is_test FROM orders""",
)
def split_chronological(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return D.split(o, 0.2, "chronological", order_by=["o_orderdate", "o_orderkey"]).select("o_orderkey", "is_test")


@query("kfold_assign", f"SELECT o_orderkey, ({hash_sql('o_orderkey', 'fold')} % 5)::INTEGER AS fold FROM orders")
def kfold_assign(spark, sf_dir):
    return D.folds(table(spark, sf_dir, "orders").select("o_orderkey"), 5, ["o_orderkey"])


@query(
    "time_series_folds",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i,
      count(*) OVER () AS n FROM orders), s AS (SELECT o_orderkey, i, n, n // 6 AS size FROM r)
    SELECT o_orderkey, CASE WHEN i < n - 5 * size THEN -1 ELSE (i - (n - 5 * size)) // size END::INTEGER AS fold FROM s""",
)
def time_series_folds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return D.time_folds(o, 5, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "fold")


@query(
    "split_boundary_preview",
    """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i,
      (SELECT floor(count(*) * 0.8 + 0.5)::BIGINT FROM orders) AS cut, (SELECT count(*) FROM orders) AS n FROM orders)
    SELECT o_orderkey, o_totalprice, CASE WHEN i <= cut THEN 'train' ELSE 'test' END AS part, cut AS train_rows,
      (n - cut)::BIGINT AS test_rows FROM r WHERE i > cut - 3 AND i <= cut + 3""",
)
def split_boundary_preview(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return D.boundary(o, 0.2, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")



# Orders whose date is missing for every seventh key: such rows come last.
GAPS_SQL = "SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS placed FROM orders"


def gaps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("placed")
    )


@query(
    "split_chronological_nulls",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY placed NULLS LAST, o_orderkey) > count(*) OVER () - ceil(count(*) OVER () * 0.2)
      AS is_test FROM ({GAPS_SQL})""",
)
def split_chronological_nulls(spark, sf_dir):
    return D.split(gaps(spark, sf_dir), 0.2, "chronological", order_by=["placed", "o_orderkey"]).select("o_orderkey", "is_test")


@query(
    "time_series_folds_nulls",
    f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY placed NULLS LAST, o_orderkey) - 1 AS i, count(*) OVER () AS n
      FROM ({GAPS_SQL})), s AS (SELECT o_orderkey, i, n, n // 6 AS size FROM r)
    SELECT o_orderkey, CASE WHEN i < n - 5 * size THEN -1 ELSE (i - (n - 5 * size)) // size END::INTEGER AS fold FROM s""",
)
def time_series_folds_nulls(spark, sf_dir):
    return D.time_folds(gaps(spark, sf_dir), 5, ["placed", "o_orderkey"]).select("o_orderkey", "fold")


@query(
    "bucket_median_null_series",
    """SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus, CAST(year(o_orderdate) AS VARCHAR) AS label,
      year(o_orderdate)::BIGINT AS sort_key, round(quantile_cont(o_totalprice, 0.5), 3) AS o_totalprice FROM orders GROUP BY 1, 2, 3""",
)
def bucket_median_null_series(spark, sf_dir):
    """The large-group path: every series counts as too large for one task."""
    o = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))
    done = X.bucket_series(
        o, "o_orderdate", ["o_totalprice"], "year", {"o_totalprice": "median"}, series=["o_orderstatus"], limit=100
    )
    return done.withColumn("o_totalprice", F.round("o_totalprice", 3))
