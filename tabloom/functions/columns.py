"""Column kinds, quoting and the single notion of a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.NumericType, T.BooleanType)
_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its literal name; dots, blanks and backticks in it are allowed."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, _NUMERIC)


def is_datetime(data_type: T.DataType) -> bool:
    return isinstance(data_type, _DATETIME)


def is_flat(data_type: T.DataType) -> bool:
    return is_numeric(data_type) or is_datetime(data_type) or isinstance(data_type, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and null are one missing value: keep null only."""
    fixed = {
        f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double; text that is no number becomes null, NaN becomes null."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.BooleanType):
        return col(name).cast("int").cast("double")
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))
    if isinstance(data_type, T.NumericType):
        return col(name).cast("double")
    if is_datetime(data_type):
        return F.lit(None).cast("double")
    return text_number(col(name).cast("string"))


# What a number looks like in text. Testing the look first keeps words away from the parser,
# where each failure costs an exception.
NUMBER_LOOK = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def text_number(text: Column) -> Column:
    """Text as double, null when it is no finite number."""
    return finite(F.when(text.rlike(NUMBER_LOOK), text.try_cast("double")))


def finite(value: Column) -> Column:
    """NaN and infinities become null."""
    infinity = F.lit(float("inf"))
    return F.when(~F.isnan(value) & (F.abs(value) < infinity), value)


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text; timestamps in the ISO form with a blank."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col(name), "yyyy-MM-dd HH:mm:ss")
    return col(name).cast("string")


def columns_to_rows(df: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row frame of per-column results into one row per record."""
    names = list(records[0])
    structs = [F.struct(*[record[n].alias(n) for n in names]) for record in records]
    return df.select(F.explode(F.array(*structs)).alias("r")).select(*[F.col(f"r.`{n}`") for n in names])


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0."""
    return F.try_divide(top, bottom)
