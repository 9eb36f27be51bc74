"""Distinct values of all columns of a table at once.

Exact counts combine (column, hash of the value) pairs: every task first drops the pairs it has already seen, so a
value travels once per task and as sixteen bytes, whatever its length. Two hashes with unlike seeds stand for a value;
that two values of a column share both is as likely as one in 3.4e38 per pair. Many `count_distinct` in one aggregate
would instead write every row once per column.

Approximate counts come from sketches of fixed size, one per column, that can be stored, e.g. one set per day of data,
and merged later without reading the data again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import as_text, col, nan_to_null

_SEEDS = (1, 2)


def _cells(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """(pos, ...) rows of the non-null cells, ``value(column)`` giving the fields beside the position."""
    clean = nan_to_null(df.select(*[col(c) for c in columns]))
    structs = [
        F.struct(F.lit(i).alias("pos"), col(c).isNotNull().alias("here"), *value(clean, c)) for i, c in enumerate(columns)
    ]
    return clean.select(F.inline(F.array(*structs))).where("here")


def _hashes(df: DataFrame, column: str) -> list[Column]:
    kind = df.schema[column].dataType
    # One zero, as count(distinct) has it.
    value = col(column) + F.lit(0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else col(column)
    return [F.xxhash64(F.lit(seed), value).alias(f"h{seed}") for seed in _SEEDS]


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(pos, name, nunique): exact numbers of distinct non-null values; columns without values are left out."""
    chosen = list(columns if columns is not None else df.columns)
    pairs = _cells(df, chosen, _hashes).groupBy("pos", *[f"h{seed}" for seed in _SEEDS]).agg(F.lit(1).alias("one"))
    counted = pairs.groupBy("pos").agg(F.count("one").alias("nunique"))
    return _named(counted, chosen)


def _named(counted: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    return counted.select(F.col("pos").cast("bigint").alias("pos"), F.element_at(names, F.col("pos") + 1).alias("name"), "nunique")


def sketch_size(rsd: float) -> int:
    """Binary digits of a sketch's buckets for a relative deviation."""
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / rsd))))


def distinct_sketches(df: DataFrame, columns: Sequence[str] | None = None, rsd: float = 0.02, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, name, sketch): one mergeable sketch per column, and per value of ``by`` if asked for."""
    chosen = list(columns if columns is not None else [c for c in df.columns if c not in by])
    clean = nan_to_null(df)
    size = F.lit(sketch_size(rsd))
    made = clean.groupBy(*[col(b) for b in by]).agg(
        *[F.hll_sketch_agg(_plain(clean, c), size).alias(f"s{i}") for i, c in enumerate(chosen)]
    )
    structs = [F.struct(F.lit(c).alias("name"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(chosen)]
    return made.select(*[col(b) for b in by], F.inline(F.array(*structs)))


def _plain(df: DataFrame, column: str) -> Column:
    """A value that sketches take; equal values stay equal."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BinaryType, T.LongType, T.IntegerType)):
        return col(column)
    return as_text(df, column) if not isinstance(kind, (T.DoubleType, T.FloatType)) else (col(column) + F.lit(0).cast(kind)).cast("string")


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, name, sketch) of sketches put together, from stored tables of any number of parts."""
    return sketches.groupBy(*[col(b) for b in by], "name").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame) -> DataFrame:
    """``sketches`` with ``nunique`` in place of the sketch."""
    return sketches.withColumn("nunique", F.hll_sketch_estimate("sketch")).drop("sketch")
