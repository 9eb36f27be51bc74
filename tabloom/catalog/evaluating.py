"""Metrics over a fixed prediction column, so that SQL gives the exact answer."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import query, table
from tabloom.operators import evaluate as V

# A plain prediction of the price and of the line number.
PRED_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice AS y,
  l_quantity * 1900.0 + 5000.0 AS pred, CASE WHEN l_returnflag = 'R' THEN l_quantity * 1900.0 + 5000.0 ELSE l_extendedprice * 0.9 END
  AS blended FROM lineitem"""
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def predicted(spark, sf_dir):
    rough = F.col("l_quantity") * 1900.0 + 5000.0
    blended = F.when(F.col("l_returnflag") == "R", rough).otherwise(F.col("l_extendedprice") * 0.9)
    return table(spark, sf_dir, "lineitem").select(
        *KEY, "l_shipdate", F.col("l_extendedprice").alias("y"), rough.alias("pred"), blended.alias("blended")
    )


METRICS = """1 - sum((y - {p}) * (y - {p})) / (count(*) * var_pop(y))"""


@query(
    "regression_metrics",
    f"""WITH t AS ({PRED_SQL}) SELECT round({METRICS.format(p='blended')}, 4) AS r2,
      round(sqrt(avg((y - blended) * (y - blended))), 4) AS rmse, round(avg(abs(y - blended)), 4) AS mae FROM t""",
)
def regression_metrics(spark, sf_dir):
    return V.regression_metrics(predicted(spark, sf_dir), "y", "blended")


@query("mape", f"WITH t AS ({PRED_SQL}) SELECT round(avg(abs((y - pred) / y)) FILTER (WHERE y <> 0) * 100, 4) AS mape FROM t")
def mape(spark, sf_dir):
    return V.mape(predicted(spark, sf_dir), "y", "pred").select(F.round("mape", 4).alias("mape"))


@query(
    "accuracy_pct",
    f"""WITH t AS ({PRED_SQL}) SELECT round(greatest(0, least(100, 100 - avg(abs((y - blended) / y)) * 100)), 2) AS accuracy_pct
    FROM t WHERE y <> 0""",
)
def accuracy_pct(spark, sf_dir):
    return V.accuracy_pct(predicted(spark, sf_dir), "y", "blended")


@query(
    "accuracy_pct_classes",
    """SELECT round(100.0 * avg((round_even(l_linenumber, 0) = round_even(l_quantity / 10, 0))::INTEGER), 2) AS accuracy_pct
    FROM lineitem""",
)
def accuracy_pct_classes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") / 10)
    return V.accuracy_pct(li, "l_linenumber", "guess", "classification")


@query(
    "task_type_rule",
    """SELECT CASE WHEN count(DISTINCT l_linenumber) <= 10 THEN 'classification' ELSE 'regression' END AS task_type, 'l_linenumber' AS target
    FROM lineitem UNION ALL
    SELECT CASE WHEN count(DISTINCT l_extendedprice) <= 10 THEN 'classification' ELSE 'forecasting' END, 'l_extendedprice' FROM lineitem""",
)
def task_type_rule(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    first = V.task_type(li, "l_linenumber").withColumn("target", F.lit("l_linenumber"))
    second = V.task_type(li, "l_extendedprice", time_based=True).withColumn("target", F.lit("l_extendedprice"))
    return first.unionByName(second)


def bootstrap_sql(source: str, key: str, top: str, bottom: str, task: str) -> str:
    marks = V.poisson_marks()
    weight = "CASE " + " ".join(f"WHEN x < {m} THEN {i}" for i, m in enumerate(marks)) + f" ELSE {len(marks)} END"
    accuracy = "t / b * 100" if task == "classification" else "greatest(0, least(100, 100 - t / b * 100))"
    return f"""WITH src AS ({source}), h AS (SELECT {top} AS t, {bottom} AS b, md5({key}) AS d FROM src),
    rows AS MATERIALIZED (SELECT t, b, CAST('0x' || substr(d, 1, 8) AS BIGINT) % {V.PRIME} AS u,
      CAST('0x' || substr(d, 9, 8) AS BIGINT) % {V.PRIME} AS v FROM h),
    ms AS (SELECT unnest({V.multipliers(200)}::BIGINT[]) AS m),
    spread AS (SELECT m, t, b, (u * m + v) % {V.PRIME} AS x FROM rows, ms),
    w AS (SELECT m, t, b, {weight} AS w FROM spread),
    reps AS (SELECT m, sum(w * t) AS t, sum(w * b) AS b FROM w GROUP BY m), a AS (SELECT {accuracy} AS a FROM reps)
    SELECT round(max(a), 2) AS ci_best, round(min(a), 2) AS ci_worst, round(avg(a), 2) AS ci_average,
      round(quantile_cont(a, 0.025), 2) AS ci_lower, round(quantile_cont(a, 0.975), 2) AS ci_upper FROM a"""


@query(
    "bootstrap_interval",
    bootstrap_sql(
        PRED_SQL, "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)",
        "CASE WHEN y <> 0 THEN abs((y - blended) / y) ELSE 0 END", "(y <> 0)::DOUBLE", "regression",
    ),
)
def bootstrap_interval(spark, sf_dir):
    return V.bootstrap(predicted(spark, sf_dir), KEY, "y", "blended")


@query(
    "bootstrap_interval_classes",
    bootstrap_sql(
        "SELECT o_orderkey, (o_orderkey % 4)::DOUBLE AS y, (o_custkey % 4)::DOUBLE AS p FROM orders",
        "CAST(o_orderkey AS VARCHAR)", "(y = p)::DOUBLE", "1.0::DOUBLE", "classification",
    ),
)
def bootstrap_interval_classes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 4).alias("y"), (F.col("o_custkey") % 4).alias("p")
    )
    return V.bootstrap(o, ["o_orderkey"], "y", "p", "classification")


BOARD_SQL = f"""WITH t AS ({PRED_SQL}), m AS (
  SELECT 'rough' AS model, round({METRICS.format(p='pred')}, 4) AS r2 FROM t
  UNION ALL SELECT 'blended', round({METRICS.format(p='blended')}, 4) FROM t
  UNION ALL SELECT 'exact', round({METRICS.format(p='y')}, 4) FROM t) """


def board(spark, sf_dir):
    df = predicted(spark, sf_dir)
    named = {"rough": "pred", "blended": "blended", "exact": "y"}
    made = None
    for model, column in named.items():
        one = V.regression_metrics(df, "y", column).select(F.lit(model).alias("model"), "r2")
        made = one if made is None else made.unionByName(one)
    return made


@query(
    "accuracy_band",
    BOARD_SQL
    + """SELECT model, r2, CASE WHEN r2 >= 0.85 THEN 'Excellent' WHEN r2 >= 0.7 THEN 'Good' WHEN r2 >= 0.5 THEN 'Fair'
      ELSE 'Weak' END AS band FROM m""",
)
def accuracy_band(spark, sf_dir):
    return V.band(board(spark, sf_dir))


@query(
    "leaderboard",
    BOARD_SQL
    + """SELECT model, r2, row_number() OVER (ORDER BY r2 DESC, model) AS place,
      row_number() OVER (ORDER BY r2 DESC, model) = 1 AS is_best FROM m""",
)
def leaderboard(spark, sf_dir):
    return V.leaderboard(board(spark, sf_dir))


def _tier_sql(basis):
    return f"""WITH t AS ({PRED_SQL}), q AS (SELECT quantile_cont({basis}, 0.25) AS lo, quantile_cont({basis}, 0.75) AS hi FROM t)
    SELECT CASE WHEN pred >= hi THEN 'Good' WHEN pred >= lo THEN 'At Risk' ELSE 'Poor' END AS tier, count(*)::BIGINT AS n,
      round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS pct FROM t, q GROUP BY 1"""


@query("prediction_tiers", _tier_sql("pred"))
def prediction_tiers(spark, sf_dir):
    return V.tiers(predicted(spark, sf_dir), "pred")


@query("prediction_tiers_by_target", _tier_sql("y"))
def prediction_tiers_by_target(spark, sf_dir):
    return V.tiers(predicted(spark, sf_dir), "pred", "y")


@query(
    "residuals",
    f"""WITH t AS ({PRED_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, y AS actual, pred AS predicted,
      round(y - pred, 4) AS residual FROM t""",
)
def residuals(spark, sf_dir):
    done = V.residuals(predicted(spark, sf_dir), "y", "pred")
    return done.select(*KEY[:3], "actual", "predicted", F.round("residual", 4).alias("residual"))


@query(
    "prediction_sample",
    f"""WITH t AS ({PRED_SQL}) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(y, 4) AS actual,
      round(pred, 4) AS predicted FROM t ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200""",
)
def prediction_sample(spark, sf_dir):
    return V.sample(predicted(spark, sf_dir), KEY, "y", "pred", 200)
