"""Missing values, coercion, calendar preparation and aggregation."""

from pyspark.sql import functions as F

from tabloom.catalog.profiling import ORDERS_GAPS_SQL, orders_gaps
from tabloom.catalog.registry import query, table
from tabloom.operators import calendar as K
from tabloom.operators import clean as C

GAPS = "WITH t AS (" + ORDERS_GAPS_SQL + ") "


@query("missing_drop", GAPS + "SELECT * FROM t WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL")
def missing_drop(spark, sf_dir):
    return C.handle_missing(orders_gaps(spark, sf_dir), "drop")


@query(
    "missing_mean",
    GAPS + "SELECT * REPLACE (round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t)), 4) AS o_totalprice) FROM t",
)
def missing_mean(spark, sf_dir):
    done = C.handle_missing(orders_gaps(spark, sf_dir), "mean")
    return done.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "missing_median",
    GAPS
    + "SELECT * REPLACE (round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t)), 4)"
    " AS o_totalprice) FROM t",
)
def missing_median(spark, sf_dir):
    done = C.handle_missing(orders_gaps(spark, sf_dir), "median")
    return done.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "coerce_numeric",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE)
      AS cust_text, NULL::DOUBLE AS o_orderpriority FROM orders""",
)
def coerce_numeric(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_custkey").cast("string"))
    frame = o.select("o_orderkey", text.alias("cust_text"), "o_orderpriority")
    return C.to_numeric(frame, ["cust_text", "o_orderpriority"])


@query("zero_fill", GAPS + "SELECT * REPLACE (coalesce(o_totalprice, 0)::DOUBLE AS o_totalprice) FROM t")
def zero_fill(spark, sf_dir):
    return C.zero_fill(orders_gaps(spark, sf_dir), ["o_totalprice"])


@query(
    "fill_from_training",
    GAPS
    + """, m AS (SELECT avg(o_totalprice) AS price, avg(o_custkey) AS cust FROM t),
    p AS (SELECT o_orderpriority AS v FROM t GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1),
    s AS (SELECT o_orderstatus AS v FROM t WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
    SELECT l_orderkey, l_linenumber, l_extendedprice,
      CASE WHEN l_linenumber = 1 THEN (SELECT v FROM s) ELSE l_linestatus END AS o_orderstatus,
      round((SELECT price FROM m), 4) AS o_totalprice, (SELECT v FROM p) AS o_orderpriority,
      round((SELECT cust FROM m), 4) AS o_custkey FROM lineitem""",
)
def fill_from_training(spark, sf_dir):
    train = orders_gaps(spark, sf_dir).select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    fresh = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        F.when(F.col("l_linenumber") != 1, F.col("l_linestatus")).alias("o_orderstatus"),
    )
    done = C.fill_from(fresh, C.train_stats(train))
    return done.withColumns({c: F.round(c, 4) for c in ("o_totalprice", "o_custkey")})


CALENDAR_TEXT_SQL = """SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS order_year,
  strftime(o_orderdate, '%B') AS order_month,
  CASE WHEN o_orderkey % 13 = 0 THEN 'none' ELSE 'Q' || quarter(o_orderdate) END AS order_qtr,
  strftime(o_orderdate, '%a') AS day_of_week, CAST(day(o_orderdate) AS VARCHAR) AS order_day,
  strftime(o_orderdate, '%d/%m/%Y') AS order_date, o_totalprice FROM orders"""


def calendar_text(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(d).cast("string").alias("order_year"),
        F.date_format(d, "MMMM").alias("order_month"),
        F.when(F.col("o_orderkey") % 13 == 0, "none").otherwise(F.concat(F.lit("Q"), F.quarter(d))).alias("order_qtr"),
        F.date_format(d, "EEE").alias("day_of_week"),
        F.dayofmonth(d).cast("string").alias("order_day"),
        F.date_format(d, "dd/MM/yyyy").alias("order_date"),
        "o_totalprice",
    )


CALENDAR_SQL = """SELECT o_orderkey, year(o_orderdate)::DOUBLE AS order_year, month(o_orderdate)::DOUBLE AS order_month,
  CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE quarter(o_orderdate) END::DOUBLE AS order_qtr,
  ((dayofweek(o_orderdate) + 6) % 7)::DOUBLE AS day_of_week, day(o_orderdate)::DOUBLE AS order_day,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice FROM orders"""


@query("calendar_numeric", CALENDAR_SQL)
def calendar_numeric(spark, sf_dir):
    done = K.calendar_numeric(calendar_text(spark, sf_dir))
    return done.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query("chrono_sort", CALENDAR_SQL)
def chrono_sort(spark, sf_dir):
    done = K.chrono_sort(K.calendar_numeric(calendar_text(spark, sf_dir)), ["o_orderkey"])
    return done.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


@query(
    "year_month_column",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, strftime(o_orderdate, '%Y-%m') AS from_parts,
      strftime(o_orderdate, '%Y-%m') AS from_text FROM orders""",
)
def year_month_column(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    o = o.withColumns(
        {
            "order_year": F.date_format("o_orderdate", "yyyy"),
            "order_month": F.date_format("o_orderdate", "MMM"),
            "order_date": F.date_format("o_orderdate", "dd.MM.yyyy"),
        }
    )
    done = K.add_year_month(o, date="o_orderdate")
    done = K.add_year_month(done, year="order_year", month="order_month", name="from_parts")
    done = K.add_year_month(done, date="order_date", name="from_text")
    return done.select("o_orderkey", "year_month", "from_parts", "from_text")


@query(
    "parse_dates",
    """WITH f AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 9 AS form FROM orders)
    SELECT o_orderkey,
      CASE WHEN form = 8 THEN NULL ELSE year(d) END::INTEGER AS year,
      CASE WHEN form = 8 THEN NULL WHEN form = 2 THEN 1 WHEN form = 3 THEN quarter(d) * 3 - 2 ELSE month(d) END::INTEGER AS month,
      CASE WHEN form = 8 THEN NULL WHEN form = 2 THEN 1 ELSE quarter(d) END::INTEGER AS quarter FROM f""",
)
def parse_dates(spark, sf_dir):
    from tabloom.functions.dates import parse_date

    d, form = F.col("o_orderdate"), F.col("o_orderkey") % 9
    text = (
        F.when(form == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(d, "MMM yyyy"))
        .when(form == 2, F.date_format(d, "yyyy"))
        .when(form == 3, F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d)))
        .when(form == 4, F.date_format(d, "dd/MM/yyyy"))
        .when(form == 5, F.date_format(d, "dd-MM-yyyy"))
        .when(form == 6, F.date_format(d, "dd.MM.yyyy"))
        .when(form == 7, F.date_format(d, "MMMM d, yyyy"))
        .otherwise("soon")
    )
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", parse_date(text).alias("p"))
    return parsed.select("o_orderkey", "p.year", "p.month", "p.quarter")


@query(
    "group_aggregate",
    """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity,
      round(quantile_cont(l_extendedprice, 0.5), 4) AS l_extendedprice, round(sum(l_tax), 4) AS l_tax,
      max(l_discount) AS l_discount, count(DISTINCT l_suppkey)::BIGINT AS l_suppkey,
      round(stddev_samp(l_partkey), 4) AS l_partkey, min(l_orderkey)::DOUBLE AS l_orderkey,
      count(l_linenumber)::BIGINT AS l_linenumber, strftime(min(l_shipdate), '%Y-%m-%d') AS l_shipdate
    FROM lineitem GROUP BY ALL""",
)
def group_aggregate(spark, sf_dir):
    done = K.aggregate(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        "mean",
        {
            "l_extendedprice": "median", "l_tax": "sum", "l_discount": "max", "l_suppkey": "nunique",
            "l_partkey": "std", "l_orderkey": "min", "l_linenumber": "count",
        },
        order_by=["l_shipdate"],
    )
    return done.withColumns(
        {
            "l_quantity": F.round("l_quantity", 6),
            "l_extendedprice": F.round("l_extendedprice", 4),
            "l_tax": F.round("l_tax", 4),
            "l_partkey": F.round("l_partkey", 4),
            "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd"),
        }
    )


@query(
    "group_aggregate_one_key",
    GAPS
    + """SELECT o_orderstatus, round(coalesce(sum(o_totalprice), 0), 2)::DOUBLE AS o_totalprice,
      sum(o_custkey)::DOUBLE AS o_custkey, sum(o_orderkey)::DOUBLE AS o_orderkey,
      strftime(arg_min(o_orderdate, (o_orderdate, o_orderkey)), '%Y-%m-%d') AS o_orderdate,
      arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority
    FROM t WHERE o_orderstatus IS NOT NULL GROUP BY 1""",
)
def group_aggregate_one_key(spark, sf_dir):
    done = K.aggregate(orders_gaps(spark, sf_dir), ["o_orderstatus"], "sum", order_by=["o_orderdate", "o_orderkey"])
    return done.withColumns(
        {"o_totalprice": F.round("o_totalprice", 2), "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd")}
    )
