"""Series for exploration: time buckets, category breakdowns, x-y rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, as_text, col, is_datetime
from tabloom.functions.dates import parsed_time
from tabloom.operators.ordered import largest_group, number_rows
from tabloom.operators.profile import top_values
from tabloom.operators.quantiles import DIRECT_LIMIT, grouped_median

GRAINS = ("year", "quarter", "month")
MAX_LINES = 6
DEFAULT_LINES = 3


def bucket_label(parsed: Column, grain: str) -> Column:
    """'2024', '2024-Q1' or '2024-03'."""
    if grain == "year":
        return parsed["year"].cast("string")
    if grain == "quarter":
        return F.format_string("%d-Q%d", parsed["year"], parsed["quarter"])
    return F.format_string("%d-%02d", parsed["year"], parsed["month"])


def bucket_key(parsed: Column, grain: str) -> Column:
    """A number that sorts the buckets."""
    if grain == "year":
        return parsed["year"]
    if grain == "quarter":
        return parsed["year"] * 10 + parsed["quarter"]
    return parsed["year"] * 100 + parsed["month"]


def _label_start(label: str, after: bool) -> str | None:
    """First day of a label's period, or of the period after it."""
    full = re.fullmatch(r"(\d{4})(?:-(?:Q([1-4])|(\d{2})))?", label)
    if not full:
        return None
    year = int(full[1])
    if full[2]:
        month, span = 3 * int(full[2]) - 2, 3
    elif full[3]:
        month, span = int(full[3]), 1
    else:
        month, span = 1, 12
    months = year * 12 + month - 1 + (span if after else 0)
    return f"{months // 12:04d}-{months % 12 + 1:02d}-01"


def in_buckets(
    df: DataFrame, time: str, grain: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Add ``label`` and ``sort_key``; rows without a time or outside the label range are left out.

    On a typed time column the range is also stated on the column itself, so that it reaches
    the scan.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain is one of {GRAINS}")
    typed = is_datetime(df.schema[time].dataType)
    rows = df
    if typed:
        low = _label_start(start, after=False) if start else None
        high = _label_start(end, after=True) if end else None
        kind = df.schema[time].dataType
        if low:
            rows = rows.where(col(time) >= F.lit(low).cast(kind))
        if high:
            rows = rows.where(col(time) < F.lit(high).cast(kind))
    parsed = parsed_time(col(time), typed) if typed else parsed_time(col(time).cast("string"), typed)
    rows = rows.withColumns({"label": bucket_label(parsed, grain), "sort_key": bucket_key(parsed, grain).cast("bigint")})
    rows = rows.where(F.col("label").isNotNull())
    if start:
        rows = rows.where(F.col("label") >= start)
    if end:
        rows = rows.where(F.col("label") <= end)
    return rows


def metric(how: str, value: Column, order: Column | None = None) -> Column:
    """One of sum, mean, median, min, max, count, latest over the numeric values of a bucket."""
    if how == "sum":
        return F.sum(value)
    if how == "mean":
        return F.avg(value)
    if how == "median":
        return F.median(value)
    if how == "min":
        return F.min(value)
    if how == "max":
        return F.max(value)
    if how == "count":
        return F.nullif(F.count(value), F.lit(0)).cast("double")
    if how == "latest":
        if order is None:
            raise ValueError("'latest' needs order_by")
        return F.max_by(value, F.when(value.isNotNull(), order))
    raise ValueError(f"unknown metric {how!r}")


def bucket_series(
    df: DataFrame,
    time: str,
    cols: Sequence[str],
    grain: str = "month",
    metrics: dict[str, str] | None = None,
    start: str | None = None,
    end: str | None = None,
    order_by: Sequence[str] | None = None,
    series: Sequence[str] = (),
    limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """One row per time bucket (and series) with a metric per column; the default is the mean."""
    lines = {c: (c, None, None) for c in cols}
    return _lines(df, time, lines, grain, metrics, start, end, order_by, series, limit)


def breakdown(
    df: DataFrame,
    time: str,
    cols: Sequence[str],
    category: str,
    values: Sequence[str] | None = None,
    grain: str = "month",
    metrics: dict[str, str] | None = None,
    start: str | None = None,
    end: str | None = None,
    order_by: Sequence[str] | None = None,
    limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """One column 'number - value' per numeric column and category value.

    Without ``values`` the three most frequent ones are drawn; more than six are refused.
    """
    if values is None:
        values = [r["value"] for r in top_values(df, category, DEFAULT_LINES).collect()]
    if len(values) > MAX_LINES:
        raise ValueError(f"at most {MAX_LINES} values")
    lines = {f"{c} — {v}": (c, category, str(v).strip()) for c in cols for v in values}
    return _lines(df, time, lines, grain, metrics, start, end, order_by, (), limit)


def _lines(df, time, lines, grain, metrics, start, end, order_by, series, limit) -> DataFrame:
    rows = in_buckets(df, time, grain, start, end)
    order = F.struct(*[col(c) for c in order_by]) if order_by else None
    groups = [*series, "label", "sort_key"]
    chosen = {key: (metrics or {}).get(c, "mean") for key, (c, _, _) in lines.items()}
    heavy = "median" in chosen.values() and largest_group(rows, groups) > limit
    aggs, medians = [], {}
    for key, (c, category, wanted) in lines.items():
        value = as_number(df, c)
        if category is not None:
            value = F.when(F.trim(as_text(df, category)) == wanted, value)
        if chosen[key] == "median" and heavy:
            medians[key] = value
        else:
            aggs.append(metric(chosen[key], value, order).alias(key))
    keys = [col(g) for g in groups]
    out = rows.groupBy(*keys).agg(*aggs) if aggs else rows.select(*keys).distinct()
    for key, value in medians.items():
        # Null series are groups too: the join compares nulls as equal.
        found = grouped_median(rows, groups, value, key, limit)
        found = found.select(*[col(g).alias(f"_m{i}") for i, g in enumerate(groups)], col(key))
        same = F.lit(True)
        for i, g in enumerate(groups):
            same = same & col(g).eqNullSafe(F.col(f"_m{i}"))
        out = out.join(found, same, "left").drop(*[f"_m{i}" for i in range(len(groups))])
    return out.select(*keys, *[col(k) for k in lines])


def xy_series(
    df: DataFrame,
    x: str | None,
    cols: Sequence[str],
    order_by: Sequence[str],
    category: str | None = None,
    value: str | None = None,
) -> DataFrame:
    """One point per row, by a numeric column or by row number; other categories give null."""
    points = {}
    for c in cols:
        v = as_number(df, c)
        if category is not None:
            v = F.when(F.trim(as_text(df, category)) == F.trim(F.lit(value)), v)
        points[c if category is None else f"{c} — {value}"] = v
    if x is None:
        numbered = number_rows(df, order_by)
        label = F.concat(F.lit("Row "), F.col("_rn").cast("string"))
        return numbered.select(label.alias("label"), *[v.alias(k) for k, v in points.items()])
    at = as_number(df, x)
    whole = at == F.floor(at)
    label = F.when(whole, at.cast("bigint").cast("string")).otherwise(at.cast("string"))
    made = df.select(
        label.alias("label"), *[v.alias(k) for k, v in points.items()], at.alias("_x"), *[col(c).alias(f"_o{i}") for i, c in enumerate(order_by)]
    )
    tie = [F.col(f"_o{i}") for i in range(len(order_by))]
    return made.orderBy("_x", *tie).drop("_x", *[f"_o{i}" for i in range(len(order_by))])
