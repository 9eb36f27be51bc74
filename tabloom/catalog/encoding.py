"""Feature encoding queries."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import query, table
from tabloom.catalog.series import hash_sql
from tabloom.functions.vectors import vector_slots
from tabloom.operators import encode as E
from tabloom.operators import split as D
from tabloom.operators.calendar import detect_calendar
from tabloom.plans.prepare import PrepareConfig, apply_prepare, fit_prepare

# Orders with numeric calendar columns.
DATED_SQL = """SELECT o_orderkey, year(o_orderdate) AS order_year, month(o_orderdate) AS order_month,
  quarter(o_orderdate) AS order_quarter, week(o_orderdate) AS order_week, day(o_orderdate) AS order_day,
  (dayofweek(o_orderdate) + 6) % 7 AS order_dow, o_totalprice FROM orders"""


def dated(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("order_year"), F.month(d).alias("order_month"),
        F.quarter(d).alias("order_quarter"), F.weekofyear(d).alias("order_week"), F.dayofmonth(d).alias("order_day"),
        F.weekday(d).alias("order_dow"), "o_totalprice",
    )


@query(
    "elapsed_time",
    f"""WITH t AS ({DATED_SQL}) SELECT o_orderkey, ((order_year - (SELECT min(order_year) FROM t)) * 12
      + order_month - (SELECT min(order_month) FROM t))::DOUBLE AS elapsed_time FROM t""",
)
def elapsed_time(spark, sf_dir):
    df = dated(spark, sf_dir)
    return E.elapsed_time(df, detect_calendar(df.columns)).select("o_orderkey", "elapsed_time")


def _waves(column, period):
    angle = f"2 * pi() * {column} / {period}"
    return f"round(sin({angle}), 9) AS {column}_sin, round(cos({angle}), 9) AS {column}_cos"


@query(
    "cyclical_calendar",
    f"WITH t AS ({DATED_SQL}) SELECT o_orderkey, "
    + ", ".join(
        _waves(c, p)
        for c, p in {
            "order_month": 12, "order_dow": 7, "order_quarter": 4, "order_week": 52, "order_day": 31,
        }.items()
    )
    + " FROM t",
)
def cyclical_calendar(spark, sf_dir):
    df = dated(spark, sf_dir)
    made = E.cyclical(df, detect_calendar(df.columns))
    names = E.cyclical_names(detect_calendar(df.columns))
    return made.select("o_orderkey", *[F.round(n, 9).alias(n) for n in names])


@query(
    "periodic_datetime",
    """WITH g AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ts FROM events),
    f AS (SELECT event_id, coalesce(last_value(ts IGNORE NULLS) OVER (ORDER BY event_id),
      first_value(ts IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM g)
    SELECT event_id, round(sin(2 * pi() * month(t) / 12), 9) AS ts_month_sin, round(cos(2 * pi() * month(t) / 12), 9) AS ts_month_cos,
      round(sin(2 * pi() * ((dayofweek(t) + 6) % 7) / 7), 9) AS ts_dow_sin,
      round(cos(2 * pi() * ((dayofweek(t) + 6) % 7) / 7), 9) AS ts_dow_cos FROM f""",
)
def periodic_datetime(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ts")
    )
    config = {"column": "ts", "type": "datetime", "period_type": "auto"}
    made = E.periodic_datetime(events, config, order_by=["event_id"])
    return made.select("event_id", *[F.round(n, 9).alias(n) for n in E.periodic_names(config)])


@query(
    "periodic_hour",
    """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 9) AS ts_hour_sin,
      round(cos(2 * pi() * hour(ts) / 24), 9) AS ts_hour_cos FROM events""",
)
def periodic_hour(spark, sf_dir):
    config = {"column": "ts", "type": "datetime", "period_type": "hour"}
    made = E.periodic_datetime(table(spark, sf_dir, "events"), config)
    return made.select("event_id", *[F.round(n, 9).alias(n) for n in E.periodic_names(config)])


@query(
    "periodic_numeric",
    """WITH s AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)
    SELECT p_partkey, round(sin(2 * pi() * (p_size - lo) / (hi - lo)), 9) AS p_size_sin,
      round(cos(2 * pi() * (p_size - lo) / (hi - lo)), 9) AS p_size_cos FROM part, s""",
)
def periodic_numeric(spark, sf_dir):
    made = E.periodic_numeric(table(spark, sf_dir, "part"), "p_size")
    return made.select("p_partkey", *[F.round(n, 9).alias(n) for n in ("p_size_sin", "p_size_cos")])


@query(
    "periodic_numeric_by_name",
    """WITH s AS (SELECT min(month(o_orderdate)) AS lo FROM orders)
    SELECT o_orderkey, round(sin(2 * pi() * (month(o_orderdate) - lo) / 12), 9) AS order_month_sin,
      round(cos(2 * pi() * (month(o_orderdate) - lo) / 12), 9) AS order_month_cos FROM orders, s""",
)
def periodic_numeric_by_name(spark, sf_dir):
    made = E.periodic_numeric(dated(spark, sf_dir), "order_month", by_name=True)
    return made.select("o_orderkey", *[F.round(n, 9).alias(n) for n in ("order_month_sin", "order_month_cos")])


FLAGS = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}


@query(
    "one_hot",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(f"({c} = '{v}')::DOUBLE AS {c}_{v}" for c, vs in FLAGS.items() for v in vs)
    + " FROM lineitem",
)
def one_hot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *FLAGS)
    return E.one_hot(li, list(FLAGS)).drop(*FLAGS)


@query(
    "one_hot_saved",
    """SELECT o_orderkey, (o_orderstatus = 'F')::DOUBLE AS o_orderstatus_F, (o_orderstatus = 'X')::DOUBLE AS o_orderstatus_X
    FROM orders""",
)
def one_hot_saved(spark, sf_dir):
    """Saved categories: 'O' and 'P' were not seen, 'X' no longer occurs."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return E.one_hot(o, ["o_orderstatus"], {"o_orderstatus": ["F", "X"]}).drop("o_orderstatus")


@query(
    "one_hot_vector",
    """WITH c AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS slot FROM (SELECT DISTINCT p_name FROM part))
    SELECT p_partkey, slot::INTEGER AS slot FROM part JOIN c USING (p_name)""",
)
def one_hot_vector(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    made = E.one_hot_vector(part, E.learn_dictionary(part, "p_name"), "v")
    return made.select("p_partkey", F.get(vector_slots(F.col("v")), 0).alias("slot"))


@query(
    "prepare_many_values",
    f"""WITH t AS (SELECT o_orderkey, c_name, o_orderpriority AS priority, c_acctbal, {hash_sql('o_orderkey')} % 100 < 20 AS is_test
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
    c AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS slot
      FROM (SELECT DISTINCT c_name FROM t WHERE NOT is_test AND c_name IS NOT NULL)),
    m AS (SELECT c_name AS mode FROM t WHERE NOT is_test AND c_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    k AS (SELECT count(DISTINCT priority) AS n FROM t WHERE NOT is_test),
    a AS (SELECT avg(c_acctbal) AS usual FROM t WHERE NOT is_test)
    SELECT o_orderkey, round(coalesce(c_acctbal, usual), 4) AS c_acctbal, slot::INTEGER AS slot,
      (SELECT count(*) FROM c) AS n_values, k.n AS n_narrow
    FROM t CROSS JOIN m CROSS JOIN a CROSS JOIN k LEFT JOIN c ON coalesce(t.c_name, m.mode) = c.c_name""",
)
def prepare_many_values(spark, sf_dir):
    """A customer name of thousands of values beside a priority of five, learned on training rows and applied to all."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    orders = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = orders.select("o_orderkey", "c_name", F.col("o_orderpriority").alias("priority"), "c_acctbal", "o_totalprice")
    train, _ = D.train_test(D.split(rows, 0.2, "random", key=["o_orderkey"]))
    config = PrepareConfig(
        target="o_totalprice", features=("c_acctbal", "c_name", "priority"), onehot_columns=("c_name", "priority"),
        row_key=("o_orderkey",), widest_onehot=40,
    )
    _, state = fit_prepare(train.drop("is_test"), config)
    made = apply_prepare(rows.drop("o_totalprice"), state, keep=["o_orderkey"])
    return made.select(
        "o_orderkey", F.round("c_acctbal", 4).alias("c_acctbal"), F.get(vector_slots(F.col("c_name_onehot")), 0).alias("slot"),
        F.lit(state.dictionaries["c_name"].size).cast("bigint").alias("n_values"),
        F.lit(len(state.categories["priority"])).cast("bigint").alias("n_narrow"),
    )


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(
    "interaction_features",
    "SELECT l_orderkey, l_partkey, l_linenumber, "
    + ", ".join(f"round(coalesce({a} * {b}, 0), 4) AS {a}_x_{b}" for a, b in PAIRS)
    + " FROM lineitem",
)
def interaction_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    made = E.interactions(li, ["l_quantity", "l_extendedprice", "l_discount"], "l_tax")
    return made.select(
        "l_orderkey", "l_partkey", "l_linenumber", *[F.round(f"{a}_x_{b}", 4).alias(f"{a}_x_{b}") for a, b in PAIRS]
    )


def _scale_sql(method):
    cols = ["l_quantity", "l_extendedprice", "l_constant"]
    if method == "minmax":
        centre, width = "min({c})", "max({c}) - min({c})"
    else:
        centre, width = "avg({c})", "stddev_pop({c})"
    stats = ", ".join(f"{centre.format(c=c)} AS c_{c}, {width.format(c=c)} AS s_{c}" for c in cols)
    done = ", ".join(f"round(({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6)::DOUBLE AS {c}" for c in cols)
    return f"""WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, 5.0::DOUBLE AS l_constant,
      {hash_sql('l_orderkey')} % 100 < 20 AS is_test FROM lineitem), s AS (SELECT {stats} FROM t WHERE NOT is_test)
    SELECT l_orderkey, l_partkey, l_linenumber, is_test, {done} FROM t, s"""


def _scaled(spark, sf_dir, method):
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", F.lit(5.0).alias("l_constant")
    )
    marked = D.split(li, 0.2, "random", key=["l_orderkey"])
    feats = ["l_quantity", "l_extendedprice", "l_constant"]
    done = E.fit_scaler(marked.where(~F.col("is_test")), feats, method).apply(marked)
    return done.withColumns({f: F.round(f, 6) for f in feats})


@query("scale_minmax", _scale_sql("minmax"))
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("scale_zscore", _scale_sql("zscore"))
def scale_zscore(spark, sf_dir):
    return _scaled(spark, sf_dir, "zscore")


@query(
    "feature_assembly",
    """SELECT p_partkey, p_size::DOUBLE AS f0, p_retailprice AS f1,
      (p_type = 'ECONOMY')::DOUBLE AS f2, (p_type = 'PROMO')::DOUBLE AS f3 FROM part""",
)
def feature_assembly(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    part = E.one_hot(table(spark, sf_dir, "part"), ["p_type"], {"p_type": ["ECONOMY", "PROMO"]})
    feats = E.ordered_unique(["p_size", "p_retailprice", "p_type_ECONOMY", "p_size", "p_type_PROMO"])
    made = E.assemble(part, feats).select("p_partkey", vector_to_array("features").alias("v"))
    return made.select("p_partkey", *[F.col("v")[i].alias(f"f{i}") for i in range(4)])
