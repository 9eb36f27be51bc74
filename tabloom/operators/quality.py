"""Anomalies and what to do with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, as_text, col, is_datetime, is_flat, is_numeric, nan_to_null
from tabloom.operators.ordered import BLOCK_ROWS, WINDOW_LIMIT, Ordered
from tabloom.operators.profile import modes, profile
from tabloom.operators.quantiles import quantiles


def _marked(df: DataFrame, key: Sequence[str], column: str, test: Column, score: Column, kind: str) -> DataFrame:
    return df.where(test).select(
        *[col(k) for k in key], F.lit(column).alias("column"), F.lit(kind).alias("kind"), score.alias("score")
    )


def outliers_z(df: DataFrame, column: str, key: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Keys of the rows more than ``threshold`` deviations from the mean."""
    value = as_number(df, column)
    row = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s")).first()
    centre, spread = row["m"], row["s"]
    if not spread:
        return _marked(df, key, column, F.lit(False), F.lit(None).cast("double"), "z_score")
    z = (value - F.lit(centre)) / F.lit(spread)
    return _marked(df, key, column, F.abs(z) > threshold, z, "z_score")


def outliers_iqr(df: DataFrame, column: str, key: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Keys of the rows beyond ``factor`` quartile ranges outside the quartiles."""
    value = as_number(df, column)
    low, high = quantiles(df, {"v": value}, [0.25, 0.75])["v"]
    if low is None:
        return _marked(df, key, column, F.lit(False), F.lit(None).cast("double"), "iqr")
    reach = factor * (high - low)
    outside = (value < F.lit(low - reach)) | (value > F.lit(high + reach))
    return _marked(df, key, column, outside, value, "iqr")


def _runs(
    df: DataFrame, keep: Column, same: Column, order_by: Sequence[str], partition_by: Sequence[str], least: int,
    limit: int, block_rows: int,
) -> DataFrame:
    """Runs of consecutive rows: a run goes on while ``same`` equals the row before.

    A new run adds 1 to a running sum, which numbers the runs; each run is then one group
    that combines before the shuffle, however long it is.
    """
    place = F.struct(*[col(c) for c in order_by])
    frame = df.withColumns({"_same": same, "_keep": keep, "_at": place})
    ordered = Ordered(frame, order_by, partition_by, limit, block_rows)
    ordered.look_back(
        1,
        lambda w: {
            "_new": F.when(
                F.row_number().over(w) == 1 if not ordered.blocked else F.lag("_rn", 1).over(w).isNull(), 1
            )
            .when(F.lag("_same", 1).over(w).eqNullSafe(F.col("_same")), 0)
            .otherwise(1)
        },
    )
    ordered.running_sum("_new", "_run")
    series = [col(c) for c in partition_by]
    runs = ordered.rows().groupBy(*series, "_run").agg(
        F.count(F.lit(1)).alias("length"),
        F.min("_at").alias("_first"),
        F.max("_at").alias("_last"),
        F.first("_same").alias("_value"),
        F.first("_keep").alias("_keep"),
    )
    found = runs.where(F.col("_keep") & (F.col("length") >= least))
    edges = [F.col(f"_first.`{c}`").alias(f"first_{c}") for c in order_by]
    edges += [F.col(f"_last.`{c}`").alias(f"last_{c}") for c in order_by]
    return found.select(*series, *edges, "length", F.col("_value").alias("value"))


def null_runs(
    df: DataFrame, column: str, order_by: Sequence[str], least: int = 5, partition_by: Sequence[str] = (),
    limit: int = WINDOW_LIMIT, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Stretches of at least five nulls in a row."""
    clean = nan_to_null(df)
    missing = col(column).isNull()
    return _runs(clean, missing, missing, order_by, partition_by, least, limit, block_rows).drop("value")


def flat_runs(
    df: DataFrame, column: str, order_by: Sequence[str], least: int = 5, partition_by: Sequence[str] = (),
    limit: int = WINDOW_LIMIT, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Stretches of at least five equal values in a row."""
    clean = nan_to_null(df)
    return _runs(clean, col(column).isNotNull(), col(column), order_by, partition_by, least, limit, block_rows)


def quarantine(df: DataFrame, anomalies: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows without an anomaly."""
    return df.join(anomalies.select(*[col(k) for k in key]).distinct(), list(key), "left_anti")


def impute(df: DataFrame, anomalies: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Anomalous values become the column's median, or its most frequent text."""
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    others = [c for c in columns if c not in numeric]
    middle = quantiles(df, {c: as_number(df, c) for c in numeric}, [0.5]) if numeric else {}
    common = modes(df, others) if others else {}
    # At most one name per column and row key.
    wrong = anomalies.groupBy(*[col(k) for k in key]).agg(F.collect_set("column").alias("_wrong"))
    joined = df.join(wrong, list(key), "left")
    made = {}
    for c in columns:
        hit = F.coalesce(F.array_contains("_wrong", c), F.lit(False))
        if c in middle:
            made[c] = F.when(hit, F.lit(middle[c][0]).cast("double")).otherwise(as_number(df, c))
        else:
            made[c] = F.when(hit, F.lit(common.get(c, "")).try_cast(df.schema[c].dataType)).otherwise(col(c))
    return joined.withColumns(made).drop("_wrong").select(*[col(c) for c in df.columns])


def quality_measures(df: DataFrame, time: str, approx: bool = False, sketches: DataFrame | None = None) -> DataFrame:
    """Per column: distinct and null ratios, and the null rate of the earlier and later half of the
    time span, with the span in days. ``approx`` and ``sketches`` as in `profile`."""
    typed = is_datetime(df.schema[time].dataType)
    stamp = col(time).cast("timestamp") if typed else as_text(df, time).try_cast("timestamp")
    seconds = F.unix_micros(stamp) / F.lit(1_000_000)
    span = df.agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi")).first()
    low, high = span["lo"] or 0.0, span["hi"] or 0.0
    early = seconds < F.lit((low + high) / 2)
    clean = nan_to_null(df)
    flat = [f.name for f in df.schema.fields if is_flat(f.dataType)]
    halves = F.array(
        *[
            F.struct(F.lit(c).alias("name"), early.alias("early"), col(c).isNull().cast("int").alias("gap"))
            for c in flat
        ]
    )
    rates = (
        clean.where(seconds.isNotNull())
        .select(F.explode(halves).alias("h"))
        .groupBy("h.name")
        .agg(
            F.coalesce(F.avg(F.when(F.col("h.early"), F.col("h.gap"))), F.lit(0.0)).alias("null_rate_early"),
            F.coalesce(F.avg(F.when(~F.col("h.early"), F.col("h.gap"))), F.lit(0.0)).alias("null_rate_late"),
        )
    )
    per_row = F.greatest(F.col("n"), F.lit(1))
    return (
        profile(df, approx, sketches=sketches)
        .join(rates, "name")
        .select(
            "name",
            (F.col("nunique") / per_row).alias("cardinality_ratio"),
            (F.col("nulls") / per_row).alias("null_ratio"),
            "null_rate_early",
            "null_rate_late",
            F.lit((high - low) / 86400).alias("span_days"),
        )
    )
