"""CSV, JSON and Parquet tables, preview rows and the report sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import NUMBER_LOOK, col, nan_to_null
from tabloom.sources.records import read_records

# Words that stand for a missing value in text files.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

ENCODINGS = ("UTF-8", "ISO-8859-1", "UTF-16")


def detect_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    return inspect_lines(spark, path, encodings)[0]


def inspect_lines(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> tuple[str, bool]:
    """The first of the encodings that fits every line, and whether a line leaves a quote open.

    Spark replaces bad bytes instead of failing, so the lines are read byte by byte (one
    character per byte) and tested: zero bytes mean UTF-16, invalid sequences rule out UTF-8.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("header", False)
    raw = lines.schema("line string").option("sep", "\x01").option("quote", "").csv(path)
    bytes_ = F.encode("line", "ISO-8859-1").cast("string")
    row = raw.agg(
        F.max(F.col("line").contains("\x00")).alias("zero"), F.min(F.is_valid_utf8(bytes_)).alias("valid"),
        F.max((F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1).alias("open"),
    ).first()
    opened = bool(row["open"])
    if row["zero"] and "UTF-16" in encodings:
        return "UTF-16", opened
    if row["valid"] is False and "UTF-8" in encodings:
        rest = [e for e in encodings if e not in ("UTF-8", "UTF-16")]
        return rest[0] if rest else "UTF-8", opened
    return encodings[0], opened


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, encodings: Sequence[str] = ENCODINGS,
    multiline: bool | None = None,
) -> DataFrame:
    """A CSV table with a header, missing-value words as null and types inferred.

    Every column is read as text first; one aggregate then decides which ones are whole
    numbers, numbers or booleans. An explicit schema saves that pass, and a single stated
    encoding the pass over the lines: give both for large tables.

    ``multiline=True`` reads line breaks inside quotes, by as many tasks as for any text file
    (see `records`); quotes must then only be used for quoting. Unstated, a table with such lines
    is refused rather than read wrongly; False takes every line as a row. UTF-16 files are always
    read whole: many small ones scale, one large one does not.
    """
    encoding, opened = (encodings[0], False) if len(encodings) == 1 else inspect_lines(spark, path, encodings)
    if opened and multiline is None and encoding != "UTF-16":
        raise ValueError("a line leaves a quote open: read with multiline=True, or multiline=False if quotes are plain text")
    if multiline and encoding != "UTF-16":
        text = read_records(spark, path, encoding)
    else:
        reader = spark.read.option("header", True).option("encoding", encoding).option("escape", '"')
        text = reader.option("multiLine", encoding == "UTF-16").option("inferSchema", False).csv(path)
    text = text.select(*[F.when(~col(c).isin(*MISSING_WORDS), col(c)).alias(c) for c in text.columns])
    if schema is not None:
        wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        return nan_to_null(text.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields]))
    return _inferred(text)


def _fits(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.lower(value).isin("true", "false")
    if kind == "bigint":
        return value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("bigint").isNotNull()
    return value.rlike(NUMBER_LOOK) | F.lower(F.trim(value)).isin("inf", "+inf", "-inf", "infinity", "-infinity")


def _inferred(text: DataFrame) -> DataFrame:
    kinds = ("bigint", "double", "boolean")
    aggs = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(text.columns)]
    for i, c in enumerate(text.columns):
        aggs += [F.count_if(col(c).isNotNull() & ~_fits(col(c), k)).alias(f"{k}{i}") for k in kinds]
    row = text.agg(*aggs).first()
    made = []
    for i, c in enumerate(text.columns):
        fitting = [k for k in kinds if row[f"n{i}"] and not row[f"{k}{i}"]]
        made.append(F.trim(col(c)).try_cast(fitting[0]).alias(c) if fitting else col(c))
    return nan_to_null(text.select(*made))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON records as a table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.json(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 8) -> DataFrame:
    """The first rows in a stated order, times as text, NaN as null."""
    rows = nan_to_null(df.orderBy(*[col(c) for c in order_by]).limit(n))
    shown = []
    for f in rows.schema.fields:
        timed = isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
        shown.append(col(f.name).cast("string").alias(f.name) if timed else col(f.name))
    return rows.select(*shown)


def write_report(df: DataFrame, path: str) -> None:
    """The score summary as CSV: model, mean, std, min, max."""
    df.select("model", "mean", "std", "min", "max").write.mode("overwrite").option("header", True).csv(path)
