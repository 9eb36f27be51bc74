"""Calendar columns, chronological order and aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import as_number, col, is_datetime, is_numeric
from tabloom.functions.dates import MONTHS, WEEKDAYS, as_timestamp, lookup, parse_date
from tabloom.operators.ordered import largest_group
from tabloom.operators.quantiles import DIRECT_LIMIT, grouped_median

# Name parts per calendar key, tried in this order; weekday words come before
# 'week' and 'day', which they contain.
_PARTS = (
    ("year", ("year",)),
    ("month", ("month",)),
    ("quarter", ("quarter", "qtr")),
    ("dayofweek", ("dayofweek", "day_of_week", "dow", "weekday")),
    ("week", ("week",)),
    ("hour", ("hour",)),
    ("day", ("day",)),
    ("date", ("date",)),
    ("timestamp", ("timestamp",)),
)

SORT_KEYS = ("year", "date", "timestamp", "month", "quarter", "week", "day", "hour")


def detect_calendar(columns: Sequence[str]) -> dict[str, str]:
    """Calendar key -> column, by name; the last match of a key wins."""
    detected: dict[str, str] = {}
    for c in columns:
        lowered = c.lower()
        for key, parts in _PARTS:
            if any(p in lowered for p in parts):
                detected[key] = c
                break
    return detected


def calendar_value(df: DataFrame, key: str, name: str) -> Column:
    """The calendar column as a number (dates as timestamps)."""
    text = isinstance(df.schema[name].dataType, T.StringType)
    number = as_number(df, name)
    if key == "month":
        if text:
            number = F.coalesce(lookup(MONTHS, col(name)).cast("double"), number)
        return F.coalesce(number, F.lit(1.0))
    if key == "dayofweek":
        if text:
            number = lookup(WEEKDAYS, col(name)).cast("double")
        return F.coalesce(number, F.lit(0.0))
    if key == "quarter":
        if text:
            number = F.regexp_extract(col(name), r"(\d+)", 1).try_cast("double")
        return F.coalesce(number, F.lit(1.0))
    if key in ("date", "timestamp"):
        if is_datetime(df.schema[name].dataType):
            return col(name)
        return as_timestamp(col(name).cast("string"))
    return F.coalesce(number, F.lit(0.0 if key == "hour" else 1.0))


def calendar_numeric(df: DataFrame, detected: dict[str, str] | None = None) -> DataFrame:
    """Month and weekday words, quarter labels and text numbers as numbers."""
    found = detect_calendar(df.columns) if detected is None else detected
    made = {c: calendar_value(df, key, c) for key, c in found.items() if c in df.columns}
    return df.withColumns(made) if made else df


def chrono_keys(detected: dict[str, str]) -> list[str]:
    return [detected[k] for k in SORT_KEYS if k in detected]


def chrono_sort(df: DataFrame, key: Sequence[str] = (), detected: dict[str, str] | None = None) -> DataFrame:
    """Rows by year, date, timestamp, month, quarter, week, day, hour, then the key."""
    found = detect_calendar(df.columns) if detected is None else detected
    order = chrono_keys(found) + [k for k in key if k not in found.values()]
    return df.orderBy(*[col(c) for c in order]) if order else df


def add_year_month(
    df: DataFrame, date: str | None = None, year: str | None = None, month: str | None = None, name: str = "year_month"
) -> DataFrame:
    """Add 'YYYY-MM' from a date column, or from a year and a month column."""
    if date is not None:
        if is_datetime(df.schema[date].dataType):
            return df.withColumn(name, F.date_format(col(date), "yyyy-MM"))
        parsed = parse_date(col(date))
        y, m = parsed["year"], parsed["month"]
    else:
        y = as_number(df, year).cast("int")
        m = calendar_value(df, "month", month).cast("int")
    label = F.format_string("%04d-%02d", y, m)
    return df.withColumn(name, F.when(y.isNotNull() & m.isNotNull(), label))


def _simple(method: str, value: Column) -> Column:
    known = {
        "mean": F.avg,
        "min": F.min,
        "max": F.max,
        "count": F.count,
        "std": F.stddev_samp,
        "var": F.var_samp,
    }
    if method == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if method not in known:
        raise ValueError(f"unknown aggregation {method!r}")
    return known[method](value)


def _is_fixed(kind: T.DataType) -> bool:
    """Whether values have a fixed size: rows are sorted, not hashed, for picks of others."""
    return is_numeric(kind) or is_datetime(kind)


def _picked(value: Column, how: str, order_by: Sequence[str]) -> Column:
    """The first or last non-null value in an order, null order keys first."""
    place = F.when(value.isNotNull(), F.struct(*[col(c) for c in order_by]))
    return F.min_by(value, place) if how == "first" else F.max_by(value, place)


def _picked_by_one(value: Column, how: str, order_by: Sequence[str]) -> Column:
    """The same for one order column, without putting it into a struct."""
    at = col(order_by[0])
    place = F.when(value.isNotNull(), at)
    unplaced = F.any_value(F.when(at.isNull(), value), F.lit(True))
    return F.coalesce(unplaced, F.min_by(value, place)) if how == "first" else F.coalesce(F.max_by(value, place), unplaced)


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    method: str = "mean",
    overrides: dict[str, str] | None = None,
    order_by: Sequence[str] | None = None,
    limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """Group rows; numeric columns by one method, others by their first value in ``order_by``.

    Rows with a null key are left out. 'first' and 'last' are taken by the order columns, so
    the result does not depend on the partitioning. All methods but the median of very large
    groups combine before the shuffle, so a hot key costs one row per task. Distinct values are
    counted apart: beside the other methods, every task would keep all of them per distinct value.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    chosen: dict[str, str] = {}
    for f in df.schema.fields:
        if f.name in keys:
            continue
        default = method if is_numeric(f.dataType) else "first"
        chosen[f.name] = (overrides or {}).get(f.name, default)
    present = F.lit(True)
    for k in keys:
        present = present & col(k).isNotNull()
    rows = df.where(present)
    heavy = "median" in chosen.values() and largest_group(rows, keys) > limit
    aggs, medians, distinct = [], [], []
    for name, how in chosen.items():
        value = as_number(df, name) if is_numeric(df.schema[name].dataType) else col(name)
        if how in ("first", "last"):
            if not order_by:
                raise ValueError(f"column {name!r} needs order_by for {how!r}")
            plain = len(order_by) == 1 and all(_is_fixed(t) for t in (df.select(value).schema[0].dataType, df.schema[order_by[0]].dataType))
            aggs.append((_picked_by_one if plain else _picked)(value, how, order_by).alias(name))
        elif how == "nunique":
            distinct.append((name, value))
        elif how == "median":
            if heavy:
                medians.append(name)
            else:
                aggs.append(F.median(value).alias(name))
        else:
            aggs.append(_simple(how, value).alias(name))
    groups = [col(k) for k in keys]
    out = rows.groupBy(*groups).agg(*aggs) if aggs else rows.select(*groups).distinct()
    for name, value in distinct:
        pairs = rows.select(*[g.alias(f"_k{i}") for i, g in enumerate(groups)], value.alias("_v")).distinct()
        found = pairs.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.count("_v").alias(name))
        same = [g == F.col(f"_k{i}") for i, g in enumerate(groups)]
        out = out.join(found, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    for name in medians:
        out = out.join(grouped_median(rows, keys, as_number(df, name), name, limit), list(keys), "left")
    return out.select(*groups, *[col(c) for c in chosen])
