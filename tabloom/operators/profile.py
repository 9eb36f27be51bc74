"""Profiling of a table: shape, types, distinct values, statistics, correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import names
from tabloom.functions.columns import (
    as_number,
    as_text,
    col,
    columns_to_rows,
    is_datetime,
    is_flat,
    is_numeric,
    nan_to_null,
    numeric_columns,
    string_columns,
)
from tabloom.functions.dates import as_timestamp
from tabloom.operators.distinct import distinct_counts, distinct_sketches, estimates
from tabloom.operators.moments import cross_products
from tabloom.operators.quantiles import quantiles


def shape(df: DataFrame) -> DataFrame:
    """Row, column and numeric-column counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_cols"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("n_numeric"),
    )


def column_type_map(df: DataFrame, samples: int = 5, numeric_first: bool = True) -> dict[str, str]:
    """numeric / datetime / categorical per column.

    Types decide, then the name, then whether one of the first non-null texts is a date. With
    ``numeric_first=False`` the values of numeric columns are tried as dates before.
    The ``samples`` smallest values per undecided column are tried.
    """
    kinds: dict[str, str] = {}
    undecided = []
    for field in df.schema.fields:
        if is_datetime(field.dataType):
            kinds[field.name] = "datetime"
        elif is_numeric(field.dataType) and numeric_first:
            kinds[field.name] = "numeric"
        elif names.name_has(field.name, names.DATE_WORDS):
            kinds[field.name] = "datetime"
        elif is_flat(field.dataType):
            undecided.append(field)
            kinds[field.name] = "numeric" if is_numeric(field.dataType) else "categorical"
        else:
            kinds[field.name] = "categorical"
    heads = []
    if undecided:
        # One pass for all columns, whatever the order of the files: the smallest distinct texts.
        texts = df.select(*[col(f.name).cast("string").alias(f.name) for f in undecided])
        heads = [(row["name"], row["value"]) for row in sample_values(texts, samples).collect()]
    if heads:
        frame = df.sparkSession.createDataFrame(heads, "name string, value string")
        dated = frame.where(as_timestamp(F.col("value")).isNotNull()).select("name").distinct()
        for row in dated.collect():
            kinds[row["name"]] = "datetime"
    return kinds


def profile(
    df: DataFrame, approx: bool = False, rsd: float = 0.02, distinct: bool = True, sketches: DataFrame | None = None
) -> DataFrame:
    """One row per column: name, pos, type, n, nulls, nunique.

    ``approx`` replaces the exact distinct counts, which move every distinct value once, by sketches of fixed size;
    ``sketches`` takes stored ones (`distinct.distinct_sketches`, merged) instead of reading the values again.
    """
    kinds = column_type_map(df)
    frame = nan_to_null(df)
    aggs = [F.count(F.lit(1)).alias("n"), *[F.count(col(name)).alias(f"c{i}") for i, name in enumerate(df.columns)]]
    records = [
        {
            "name": F.lit(name),
            "pos": F.lit(i).cast("bigint"),
            "type": F.lit(kinds[name]),
            "numeric": F.lit(is_numeric(df.schema[name].dataType)),
            "n": F.col("n"),
            "nulls": F.col("n") - F.col(f"c{i}"),
        }
        for i, name in enumerate(df.columns)
    ]
    facts = columns_to_rows(frame.agg(*aggs), records)
    if not distinct:
        return facts.withColumn("nunique", F.lit(None).cast("bigint"))
    if approx or sketches is not None:
        found = estimates(sketches if sketches is not None else distinct_sketches(df, rsd=rsd))
    else:
        found = distinct_counts(df)
    # One row per column on both sides.
    known = found.select(F.col("name").alias("_name"), F.col("nunique").alias("_u"))
    joined = facts.join(F.broadcast(known), F.col("name") == F.col("_name"), "left")
    return joined.withColumn("nunique", F.coalesce("_u", F.lit(0)).cast("bigint")).drop("_name", "_u")


def column_types(df: DataFrame) -> DataFrame:
    """Logical type and non-null count of every column."""
    found = profile(df, distinct=False)
    return found.select("name", "pos", "type", (F.col("n") - F.col("nulls")).alias("filled"))


def cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values and percentage of missing ones per column."""
    found = profile(df, approx)
    missing = F.when(F.col("n") > 0, F.round(100 * F.col("nulls") / F.col("n"), 1)).otherwise(0.0)
    return found.select("name", F.col("nunique").alias("cardinality"), missing.alias("null_pct"))


def unpivot_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value) rows of the chosen columns, values as text, missing ones left out."""
    clean = nan_to_null(df.select(*[col(c) for c in columns]))
    texts = clean.select(*[as_text(clean, c).alias(c) for c in columns])
    return texts.unpivot([], [col(c) for c in columns], "name", "value").where(F.col("value").isNotNull())


def sample_values(df: DataFrame, n: int = 8) -> DataFrame:
    """The n smallest distinct values per column, as text.

    Every task keeps the n smallest of each of its columns while it reads; only those are brought together.
    """
    flat = [f.name for f in df.schema.fields if is_flat(f.dataType)]
    if not flat:
        return df.sparkSession.createDataFrame([], "name string, place bigint, value string")
    clean = nan_to_null(df.select(*[col(c) for c in flat]))
    texts = clean.select(*[as_text(clean, c).alias(f"c{i}") for i, c in enumerate(flat)])

    def smallest(batches):
        kept = [pa.array([], pa.string()) for _ in flat]
        for batch in batches:
            for i in range(len(kept)):
                fresh = pc.unique(batch.column(i).drop_null().cast(pa.string()))
                both = pc.unique(pa.concat_arrays([kept[i], fresh])) if len(fresh) else kept[i]
                kept[i] = both.take(pc.sort_indices(both)[:n])
        places = pa.array([i for i, k in enumerate(kept) for _ in range(len(k))], pa.int32())
        yield pa.RecordBatch.from_arrays([places, pa.concat_arrays(kept)], ["pos", "value"])

    found = texts.mapInArrow(smallest, "pos int, value string").distinct()
    place = F.row_number().over(Window.partitionBy("pos").orderBy("value"))
    names_ = F.array(*[F.lit(c) for c in flat])
    return (
        found.withColumn("place", place)
        .where(F.col("place") <= n)
        .select(F.element_at(names_, F.col("pos") + 1).alias("name"), F.col("place").cast("bigint").alias("place"), "value")
    )


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """mean, median, sample deviation, min and max per numeric column, 4 digits, missing -> 0."""
    chosen = list(columns or numeric_columns(df))
    values = {c: as_number(df, c) for c in chosen}
    medians = quantiles(df, values, [0.5])
    aggs = []
    for i, c in enumerate(chosen):
        v = values[c]
        aggs += [
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
        ]
    def shown(value: Column) -> Column:
        return F.coalesce(F.round(value, 4), F.lit(0.0))
    records = [
        {
            "name": F.lit(c),
            "mean": shown(F.col(f"mean{i}")),
            "median": shown(F.lit(medians[c][0]).cast("double")),
            "std": shown(F.col(f"std{i}")),
            "min": shown(F.col(f"min{i}")),
            "max": shown(F.col(f"max{i}")),
        }
        for i, c in enumerate(chosen)
    ]
    return columns_to_rows(df.agg(*aggs), records)


def datetime_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Earliest and latest day per column, '' when nothing parses."""
    aggs, records = [], []
    for i, c in enumerate(columns):
        typed = is_datetime(df.schema[c].dataType)
        stamp = col(c).cast("timestamp") if typed else as_timestamp(col(c))
        aggs += [F.min(stamp).alias(f"lo{i}"), F.max(stamp).alias(f"hi{i}")]
        records.append(
            {
                "name": F.lit(c),
                "min": F.coalesce(F.date_format(f"lo{i}", "yyyy-MM-dd"), F.lit("")),
                "max": F.coalesce(F.date_format(f"hi{i}", "yyyy-MM-dd"), F.lit("")),
            }
        )
    return columns_to_rows(df.agg(*aggs), records)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, n) for text values."""
    return unpivot_text(df, columns).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent text per column, the smallest among equals; one row per column reaches the driver."""
    counts = value_counts(df, columns)
    top = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    return {r["name"]: r["mode"] for r in top.collect()}


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every category of every text column with its count and a mark on the mode.

    One row per category instead of a list per column, so that a column of many categories
    stays spread over the cluster.
    """
    chosen = list(columns or string_columns(df))
    counts = value_counts(df, chosen)
    top = modes(df, chosen)
    is_mode = F.lit(False)
    for name, value in top.items():
        is_mode = is_mode | ((F.col("name") == name) & (F.col("value") == value))
    return counts.withColumn("is_mode", is_mode)


def _pair_frame(df: DataFrame, cols: Sequence[str], nulls: str) -> tuple[DataFrame, list[str]]:
    values = []
    for i, c in enumerate(cols):
        v = as_number(df, c)
        values.append((F.coalesce(v, F.lit(0.0)) if nulls == "zero" else v).alias(f"x{i}"))
    return df.select(*values), [f"x{i}" for i in range(len(cols))]


def correlation_table(df: DataFrame, cols: Sequence[str], nulls: str = "pairwise") -> list[tuple[str, str, float]]:
    """Pearson r of every pair a <= b by position, unrounded; constants give 0.

    Means come first, so that the co-moments are sums of products around them. A pair with gaps uses the rows where
    both are present: products of the values, their squares and their presence give all its sums, in one pass at any
    number of columns.
    """
    frame, xs = _pair_frame(df, cols, nulls)
    k = len(cols)
    means = frame.agg(*[F.avg(x).alias(x) for x in xs]).first()
    values = [F.coalesce(F.col(x) - F.lit(means[x]).cast("double"), F.lit(0.0)) for x in xs]
    here = [F.col(x).isNotNull().cast("double") for x in xs]
    found = cross_products(frame, [*values, *here], [*values, *here, *[v * v for v in values]]).get(0)
    if found is None:
        found = np.zeros((2 * k, 3 * k))
    blocks = (found[:k, :k], found[:k, k : 2 * k], found[k:, k : 2 * k], found[k:, 2 * k :])
    xy, sums, n, squares = (block.tolist() for block in blocks)
    return [
        (cols[i], cols[j], _pearson(n[i][j], sums[i][j], sums[j][i], squares[j][i], squares[i][j], xy[i][j]))
        for i in range(k)
        for j in range(i, k)
    ]


def _pearson(n: float, x: float, y: float, xx: float, yy: float, xy: float) -> float:
    """r from sums; a spread that is only rounding noise counts as none."""
    if not n:
        return 0.0
    sx, sy = xx - x * x / n, yy - y * y / n
    if sx <= 1e-12 * xx or sy <= 1e-12 * yy:
        return 0.0
    return (xy - x * y / n) / (sx * sy) ** 0.5


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, nulls: str = "pairwise") -> DataFrame:
    """Long table (col_a, col_b, r) over all ordered pairs, 4 digits; constants give 0."""
    chosen = list(cols or numeric_columns(df))
    if nulls not in ("pairwise", "zero"):
        raise ValueError("nulls is 'pairwise' or 'zero'")
    rows = []
    for a, b, r in correlation_table(df, chosen, nulls):
        if nulls == "zero" and a == b:
            r = 1.0
        rows.append((a, b, r))
        if a != b:
            rows.append((b, a, r))
    made = df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")
    return made.withColumn("r", F.round("r", 4))


def target_correlations(df: DataFrame, feats: Sequence[str], target: str, nulls: str = "zero") -> dict[str, float]:
    """Pearson r of every feature with the target, one pass over means and one over moments."""
    names_ = [*feats, target]
    frame, xs = _pair_frame(df, names_, nulls)
    means = frame.agg(*[F.avg(x).alias(x) for x in xs]).first()
    y = F.col(xs[-1]) - F.lit(means[xs[-1]]).cast("double")
    aggs = []
    for x in xs[:-1]:
        both = F.col(x).isNotNull() & F.col(xs[-1]).isNotNull()
        v, w = F.when(both, F.col(x) - F.lit(means[x]).cast("double")), F.when(both, y)
        for part, term in (("x", v), ("y", w), ("xx", v * v), ("yy", w * w), ("xy", v * w)):
            aggs.append(F.sum(term).alias(f"{part}_{x}"))
        aggs.append(F.count(v).alias(f"n_{x}"))
    if not aggs:
        return {}
    row = frame.agg(*aggs).first()
    return {
        f: _pearson(*(row[f"{p}_{x}"] or 0.0 for p in ("n", "x", "y", "xx", "yy", "xy")))
        for f, x in zip(feats, xs[:-1], strict=True)
    }


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The n most frequent trimmed, non-blank values; ties by value."""
    value = F.trim(as_text(df, column))
    counts = df.select(value.alias("value")).where(F.length("value") > 0).groupBy("value")
    return counts.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any cell contains the text, ignoring case."""
    needle = text.lower()
    hit = F.lit(False)
    for field in df.schema.fields:
        if not isinstance(field.dataType, T.BinaryType):
            hit = hit | F.coalesce(F.lower(as_text(df, field.name)).contains(needle), F.lit(False))
    return df.where(hit)


def sort_rows(df: DataFrame, column: str, desc: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """Rows by one column, missing values last, ties by the key."""
    first = col(column).desc_nulls_last() if desc else col(column).asc_nulls_last()
    return df.orderBy(first, *[col(k) for k in key])
