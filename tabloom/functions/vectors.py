"""Sparse ML vectors as column expressions.

SQL has no constructor for a sparse vector. Its JSON form is read instead, which stays inside the JVM.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOLDER = T.StructType([T.StructField("v", VectorUDT())])
_PARTS = "v struct<indices: array<int>, values: array<double>>"


def is_vector(data_type: T.DataType) -> bool:
    return isinstance(data_type, VectorUDT)


def vector_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_vector(f.dataType)]


def unit_vector(slot: Column, size: int) -> Column:
    """A sparse vector of ``size`` entries with 1 at ``slot`` (0-based); null gives the zero vector."""
    place = slot.cast("int")
    indices = F.when(place.isNull(), F.array().cast("array<int>")).otherwise(F.array(place))
    values = F.when(place.isNull(), F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0)))
    parts = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _HOLDER)["v"]


def vector_slots(vector: Column) -> Column:
    """The places that a sparse vector fills, as an array of integers."""
    return F.from_json(F.to_json(F.struct(vector.alias("v"))), _PARTS)["v"]["indices"]
