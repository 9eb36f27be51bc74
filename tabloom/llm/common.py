"""Shared pieces: words, letter folding, intermediate tables, batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.session import scratch_path

#: White space of every word rule here, as a character class.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Python tasks take texts in slices of about this many bytes.
SLICE_BYTES = 8_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ``lower`` does it fast where a text is plain ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a text between blanks; no words give an empty array, null gives an empty array."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in ``column`` hold about ``limit`` bytes; one text is never cut."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def shield(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called like ``names`` put out of the way, and how to rename them back."""
    aside = {}
    for column in df.columns:
        if column.lower() in names:
            aside[column] = free_name(df, f"own_{column}")
    return df.withColumnsRenamed(aside), {new: old for old, new in aside.items()}


def put_aside(df: DataFrame, names: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its columns called like ``names`` renamed to ``own_<name>``, but for those of ``keep``."""
    return shield(df, tuple(n for n in names if n not in {k.lower() for k in keep}))[0]
