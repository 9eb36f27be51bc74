"""Data quality queries."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import query, table
from tabloom.operators import quality as Q

# Events with gaps: 6 of every 40 ids in a row hold no value, and values are coarse enough to repeat.
EVENTS_SQL = """SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id % 40 < 6 THEN NULL ELSE value END AS value, floor(value / 100) AS level FROM events"""


def events_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").drop("props")
    return e.withColumns(
        {
            "value": F.when(F.col("event_id") % 40 >= 6, F.col("value")),
            "level": F.floor(F.col("value") / 100).cast("double"),
        }
    )


Z_SQL = """SELECT event_id, 'value' AS "column", 'z_score' AS kind, round((value - m) / s, 6) AS score FROM e,
  (SELECT avg(value) AS m, stddev_samp(value) AS s FROM e) WHERE abs((value - m) / s) > 3"""


@query("outlier_zscore", f"WITH e AS ({EVENTS_SQL}) {Z_SQL}")
def outlier_zscore(spark, sf_dir):
    return Q.outliers_z(events_gaps(spark, sf_dir), "value", ["event_id"]).withColumn("score", F.round("score", 6))


IQR_SQL = """SELECT event_id, 'value' AS "column", 'iqr' AS kind, value AS score FROM e,
  (SELECT quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM e)
  WHERE value < lo - 1.5 * (hi - lo) OR value > hi + 1.5 * (hi - lo)"""


@query("outlier_iqr", f"WITH e AS ({EVENTS_SQL}) {IQR_SQL}")
def outlier_iqr(spark, sf_dir):
    return Q.outliers_iqr(events_gaps(spark, sf_dir), "value", ["event_id"])


def run_sql(flag, keep, extra=""):
    return f"""WITH e AS ({EVENTS_SQL}), f AS (SELECT *, {flag} AS v,
      CASE WHEN row_number() OVER w = 1 OR lag({flag}) OVER w IS DISTINCT FROM {flag} THEN 1 ELSE 0 END AS fresh FROM e
      WINDOW w AS (ORDER BY ts, event_id)),
    r AS (SELECT *, sum(fresh) OVER (ORDER BY ts, event_id) AS run FROM f)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, arg_min(event_id, (ts, event_id)) AS first_event_id,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, arg_max(event_id, (ts, event_id)) AS last_event_id,
      count(*)::BIGINT AS length{extra} FROM r GROUP BY run HAVING count(*) >= 5 AND {keep}"""


def timed(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_ts", "last_ts")})


@query("null_spike", run_sql("(value IS NULL)", "bool_or(value IS NULL)"))
def null_spike(spark, sf_dir):
    return timed(Q.null_runs(events_gaps(spark, sf_dir), "value", ["ts", "event_id"]))


@query("flatline", run_sql("level", "count(level) > 0", ", any_value(level)::DOUBLE AS value"))
def flatline(spark, sf_dir):
    return timed(Q.flat_runs(events_gaps(spark, sf_dir), "level", ["ts", "event_id"], limit=4_000, block_rows=4_000))


ANOMALIES_SQL = f"e AS ({EVENTS_SQL}), a AS ({Z_SQL} UNION ALL {IQR_SQL})"


def anomalies(df):
    return Q.outliers_z(df, "value", ["event_id"]).unionByName(Q.outliers_iqr(df, "value", ["event_id"]))


@query(
    "quarantine_rows",
    f"WITH {ANOMALIES_SQL} SELECT event_id, user_id, event_type, value, level FROM e WHERE event_id NOT IN (SELECT event_id FROM a)",
)
def quarantine_rows(spark, sf_dir):
    df = events_gaps(spark, sf_dir)
    return Q.quarantine(df, anomalies(df), ["event_id"]).drop("ts")


@query(
    "impute_anomalies",
    f"""WITH {ANOMALIES_SQL}, x AS (SELECT event_id, "column" AS c FROM a UNION ALL SELECT event_id, 'event_type' FROM e WHERE user_id = 7)
    SELECT event_id, user_id,
      CASE WHEN event_id IN (SELECT event_id FROM x WHERE c = 'event_type')
        THEN (SELECT event_type FROM e GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) ELSE event_type END AS event_type,
      CASE WHEN event_id IN (SELECT event_id FROM x WHERE c = 'value') THEN (SELECT quantile_cont(value, 0.5) FROM e) ELSE value END AS value,
      level FROM e""",
)
def impute_anomalies(spark, sf_dir):
    df = events_gaps(spark, sf_dir)
    wrong = anomalies(df).select("event_id", "column")
    types = df.where(F.col("user_id") == 7).select("event_id", F.lit("event_type").alias("column"))
    return Q.impute(df, wrong.unionByName(types), ["event_id"], ["value", "event_type"]).drop("ts")


def _measure_sql():
    cols = ["event_id", "ts", "user_id", "event_type", "value", "level"]
    early = "epoch_us(ts) / 1e6 < (SELECT (min(epoch_us(ts)) / 1e6 + max(epoch_us(ts)) / 1e6) / 2 FROM e)"
    return f"WITH e AS ({EVENTS_SQL}), m AS MATERIALIZED (SELECT *, {early} AS early FROM e) " + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS name, round(count(DISTINCT {c}) / count(*), 6) AS cardinality_ratio,
        round((count(*) - count({c})) / count(*), 6) AS null_ratio,
        round(avg(({c} IS NULL)::INTEGER) FILTER (WHERE early), 6) AS null_rate_early,
        round(avg(({c} IS NULL)::INTEGER) FILTER (WHERE NOT early), 6) AS null_rate_late,
        round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 86400, 4) AS span_days FROM m"""
        for c in cols
    )


@query("quality_measures", _measure_sql())
def quality_measures(spark, sf_dir):
    done = Q.quality_measures(events_gaps(spark, sf_dir), "ts")
    digits = {"cardinality_ratio": 6, "null_ratio": 6, "null_rate_early": 6, "null_rate_late": 6, "span_days": 4}
    return done.withColumns({c: F.round(c, d) for c, d in digits.items()})
