"""Forecasts over monthly totals (in millions) per order status and priority."""

from pyspark.sql import functions as F

from tabloom.catalog.algebra import comoments, predicted, solved
from tabloom.catalog.registry import query, table
from tabloom.operators import explore as X
from tabloom.operators.lags import MONTH_SERIES_BOUND
from tabloom.operators.models import fit_linear
from tabloom.plans import arma as A
from tabloom.plans import forecast as G

SERIES = ["o_orderstatus", "o_orderpriority"]

SERIES_SQL = """SELECT o_orderstatus, o_orderpriority, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS sort_key,
  sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY ALL"""
KEYS = "o_orderstatus, o_orderpriority"


def many(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = X.bucket_series(o, "o_orderdate", ["o_totalprice"], "month", {"o_totalprice": "sum"}, series=SERIES)
    return made.select(*SERIES, "sort_key", (F.col("o_totalprice") / 1e6).alias("y"))


LINEAR_SQL = f"""SELECT {KEYS}, step, value, greatest(0, value - (0.05 * value + 0.02 * step * value)) AS lower,
  value + 0.05 * value + 0.02 * step * value AS upper FROM (
    SELECT {KEYS}, step, greatest(0, last + slope * step) AS value FROM (
      SELECT {KEYS}, arg_max(y, sort_key) AS last,
        CASE WHEN count(*) > 1 THEN (arg_max(y, sort_key) - arg_min(y, sort_key)) / (count(*) - 1) ELSE 0 END AS slope
      FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY sort_key DESC) AS p FROM ({SERIES_SQL})) WHERE p <= 10
      GROUP BY {KEYS}), range(1, 13) s(step))"""


def rounded(sql, digits=4):
    return (
        f"SELECT {KEYS}, step::INTEGER AS step, round(value, {digits}) AS value, round(lower, {digits}) AS lower,"
        f" round(upper, {digits}) AS upper FROM ({sql})"
    )


@query("forecast_linear", rounded(LINEAR_SQL))
def forecast_linear(spark, sf_dir):
    return G.forecast_linear(many(spark, sf_dir), SERIES, ["sort_key"], "y", 12)


@query(
    "forecast_compound",
    """WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders),
    b AS (SELECT s * o_custkey + i AS base FROM orders, f ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)
    SELECT step::INTEGER AS step, round(base * (1 + 0.01 * step), 4) AS value FROM b, range(1, 11) r(step)""",
)
def forecast_compound(spark, sf_dir):
    """From the prediction for the latest order."""
    o = table(spark, sf_dir, "orders")
    fitted = fit_linear(o, ["o_custkey"], "o_totalprice")
    base = fitted.predict(o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1))
    return G.forecast_compound(base, "prediction", 10)


AR_PARTS = f"""d AS (SELECT *, y - lag(y, 1) OVER w AS d, lag(y, 1) OVER w - lag(y, 2) OVER w AS p FROM ({SERIES_SQL})
    WINDOW w AS (PARTITION BY {KEYS} ORDER BY sort_key)),
  s AS (SELECT {KEYS}, sum(d * p) AS dp, sum(p * p) FILTER (WHERE d IS NOT NULL) AS pp, sum(d * d) FILTER (WHERE p IS NOT NULL) AS dd,
    count(d * p) AS m, arg_max(y, sort_key) AS last, arg_max(d, sort_key) AS change FROM d GROUP BY {KEYS}),
  f AS (SELECT *, greatest(-0.99, least(0.99, coalesce(dp / nullif(pp, 0), 0))) AS phi FROM s),
  v AS (SELECT *, greatest(coalesce((dd - 2 * phi * dp + phi * phi * pp) / nullif(m, 0), 0), 0) AS sigma2 FROM f),
  h AS (SELECT step, j FROM range(1, 13) a(step), range(0, 12) b(j) WHERE j < step)"""
AR_SQL = f"""WITH {AR_PARTS}, r AS (SELECT {KEYS}, step, any_value(last) AS last, any_value(change) AS change, any_value(sigma2) AS sigma2,
    sum(pow(phi, j + 1)) AS rise, sum(pow((1 - pow(phi, j + 1)) / (1 - phi), 2)) AS spread FROM v, h GROUP BY {KEYS}, step)
  SELECT {KEYS}, step, last + change * rise AS value, last + change * rise - 1.959963984540054 * sqrt(sigma2 * spread) AS lower,
    last + change * rise + 1.959963984540054 * sqrt(sigma2 * spread) AS upper FROM r"""


@query("forecast_ar", rounded(AR_SQL))
def forecast_ar(spark, sf_dir):
    return G.forecast_ar(many(spark, sf_dir), SERIES, ["sort_key"], "y", 12, largest=MONTH_SERIES_BOUND)


SEASONAL_SQL = f"""WITH d AS (SELECT *, y - lag(y, 1) OVER w AS d, (y - lag(y, 1) OVER w) - (lag(y, 12) OVER w - lag(y, 13) OVER w) AS wd,
      (lag(y, 1) OVER w - lag(y, 2) OVER w) - (lag(y, 13) OVER w - lag(y, 14) OVER w) AS p,
      row_number() OVER (PARTITION BY {KEYS} ORDER BY sort_key DESC) AS back FROM ({SERIES_SQL})
    WINDOW w AS (PARTITION BY {KEYS} ORDER BY sort_key)),
  s AS (SELECT {KEYS}, sum(wd * p) AS dp, sum(p * p) FILTER (WHERE wd IS NOT NULL) AS pp, sum(wd * wd) FILTER (WHERE p IS NOT NULL) AS dd,
    count(wd * p) AS m, arg_max(y, sort_key) AS last, coalesce(arg_max(wd, sort_key), 0) AS change,
    count(d) FILTER (WHERE back <= 12) AS n FROM d GROUP BY {KEYS}),
  f AS (SELECT *, greatest(-0.99, least(0.99, coalesce(dp / nullif(pp, 0), 0))) AS phi FROM s),
  v AS (SELECT *, greatest(coalesce((dd - 2 * phi * dp + phi * phi * pp) / nullif(m, 0), 0), 0) AS sigma2 FROM f),
  steps AS (SELECT i FROM range(1, 13) t(i)),
  step_change AS (SELECT v.{KEYS.replace(', ', ', v.')}, i, any_value(v.last) AS last,
      any_value(coalesce(d.d, 0) + pow(phi, i) * change) AS ch
    FROM v CROSS JOIN steps LEFT JOIN d ON d.o_orderstatus = v.o_orderstatus AND d.o_orderpriority = v.o_orderpriority
      AND d.back = n - (i - 1) % greatest(n, 1) GROUP BY ALL),
  w AS (SELECT {KEYS}, sigma2, i, pow((1 - pow(phi, i)) / (1 - phi), 2) AS psi2 FROM v, steps),
  r AS (SELECT c.{KEYS.replace(', ', ', c.')}, c.i AS step,
    c.last + sum(c.ch) OVER (PARTITION BY {', '.join('c.' + k for k in KEYS.split(', '))} ORDER BY c.i) AS value,
    sqrt(sigma2 * sum(psi2) OVER (PARTITION BY {', '.join('c.' + k for k in KEYS.split(', '))} ORDER BY c.i)) AS dev
    FROM step_change c JOIN w USING ({KEYS}, i))
  SELECT {KEYS}, step, value, value - 1.959963984540054 * dev AS lower, value + 1.959963984540054 * dev AS upper FROM r"""


@query("forecast_seasonal_ar", rounded(SEASONAL_SQL))
def forecast_seasonal_ar(spark, sf_dir):
    return G.forecast_seasonal_ar(many(spark, sf_dir), SERIES, ["sort_key"], "y", 12, largest=MONTH_SERIES_BOUND)


_NULL_KEYS = f"SELECT nullif(o_orderstatus, 'O') AS o_orderstatus, {KEYS.split(', ')[1]}, step, value, lower, upper FROM"


@query("seasonal_ar_null_series", f"{_NULL_KEYS} ({rounded(SEASONAL_SQL)})")
def seasonal_ar_null_series(spark, sf_dir):
    """One order status is missing: its series are forecast like any other."""
    series = many(spark, sf_dir).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")))
    return G.forecast_seasonal_ar(series, SERIES, ["sort_key"], "y", 12, largest=MONTH_SERIES_BOUND)


@query("forecast_arma")
def forecast_arma(spark, sf_dir):
    """Orders of up to two autoregressive and two moving-average terms, chosen per series."""
    return A.forecast_arma(many(spark, sf_dir), SERIES, ["sort_key"], "y", 12, largest=MONTH_SERIES_BOUND)


@query("forecast_seasonal_arma")
def forecast_seasonal_arma(spark, sf_dir):
    return A.forecast_arma(many(spark, sf_dir), SERIES, ["sort_key"], "y", 12, season=12, largest=MONTH_SERIES_BOUND)


EXOG_FEATS = ["lag", "x"]
EXOG_SQL = f"""WITH m AS (SELECT {KEYS}, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS sort_key, sum(o_totalprice) AS y,
    count(o_custkey)::DOUBLE AS x FROM orders GROUP BY ALL),
  t AS MATERIALIZED (SELECT *, lag(y) OVER (PARTITION BY {KEYS} ORDER BY sort_key) AS lag FROM m),
  f AS ({solved(f"SELECT {comoments(EXOG_FEATS, 'y')} FROM t WHERE lag IS NOT NULL", 2)}),
  v AS (SELECT avg((y - ({predicted(EXOG_FEATS)})) * (y - ({predicted(EXOG_FEATS)}))) AS variance, any_value(b + b1 * mx) AS drift, any_value(b0) AS phi
    FROM t, f, (SELECT avg(x) AS mx FROM t WHERE lag IS NOT NULL) WHERE lag IS NOT NULL),
  l AS (SELECT {KEYS}, arg_max(y, sort_key) AS last FROM t GROUP BY {KEYS}),
  r AS (SELECT {KEYS}, step, pow(phi, step) * last + drift * (1 - pow(phi, step)) / (1 - phi) AS value,
    1.959963984540054 * sqrt(variance * (1 - pow(phi, 2 * step)) / (1 - phi * phi)) AS reach FROM l, v, range(1, 13) s(step))
  SELECT {KEYS}, step, value, value - reach AS lower, value + reach AS upper FROM r"""


@query("forecast_exog", rounded(EXOG_SQL, 1))
def forecast_exog(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = X.bucket_series(
        o, "o_orderdate", ["o_totalprice", "o_custkey"], "month", {"o_totalprice": "sum", "o_custkey": "count"}, series=SERIES
    )
    done = G.forecast_exog(made, SERIES, ["sort_key"], "o_totalprice", ["o_custkey"], 12, largest=MONTH_SERIES_BOUND)
    return done.withColumns({c: F.round(c, 1) for c in ("value", "lower", "upper")})


def _table_sql():
    case = "max({c}) FILTER (WHERE model = '{m}') AS \"{n}\""
    cols = [case.format(c=c, m="ar", n=n) for c, n in (
        ("value", "value"), ("value", "average_case"), ("lower", "worst_case"), ("upper", "best_case"))]
    for m in ("linear", "ar"):
        cols += [case.format(c=c, m=m, n=n) for c, n in (
            ("value", m), ("value", f"{m}_average"), ("lower", f"{m}_worst"), ("upper", f"{m}_best"))]
    return f"""WITH l AS ({rounded(LINEAR_SQL)}), a AS ({rounded(AR_SQL)}),
    u AS (SELECT *, 'linear' AS model FROM l UNION ALL SELECT *, 'ar' FROM a) SELECT {KEYS}, step, {', '.join(cols)} FROM u GROUP BY {KEYS}, step"""


@query("forecast_table", _table_sql())
def forecast_table(spark, sf_dir):
    return G.forecast_table(
        {"linear": forecast_linear(spark, sf_dir), "ar": forecast_ar(spark, sf_dir)}, "ar", SERIES
    )
