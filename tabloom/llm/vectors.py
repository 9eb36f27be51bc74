"""Columns of vectors: which rows count, and their entries as scaled whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col


def usable(df: DataFrame, vector: str, limit: float) -> DataFrame:
    """Rows whose vector is there, is not empty and holds only numbers between -limit and limit."""
    fine = F.forall(col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < limit))
    return df.where(F.coalesce(fine & (F.size(col(vector)) > 0), F.lit(False)))


def commonest_length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, the longest among equally common ones; 0 without rows."""
    sizes = df.groupBy(F.size(col(vector)).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return row["d"] if row else 0


def whole(column: pa.Array, d: int, scale: int) -> np.ndarray:
    """floor(scale * c), one row per list of a column of lists of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(-1, d)
