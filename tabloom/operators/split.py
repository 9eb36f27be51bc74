"""Train/test splits and folds.

Random splits hash a business key. Chronological ones find the order keys at the cut ranks and
compare every row with them, so nothing is sorted or moved. Null order keys come last.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import col, is_datetime
from tabloom.functions.hashing import key_hash
from tabloom.operators.ordered import number_rows
from tabloom.operators.quantiles import DIRECT_LIMIT, after_key, keys_at_ranks


def _selectable(df: DataFrame, order_by: Sequence[str]) -> bool:
    kinds = [df.schema[c].dataType for c in order_by]
    return all(isinstance(k, T.NumericType) or is_datetime(k) for k in kinds)


def _beyond(df: DataFrame, order_by: Sequence[str], ranks: list[int], limit: int) -> tuple[DataFrame, list[Column]]:
    """For each 0-based rank, a test for the rows after it."""
    if _selectable(df, order_by):
        inside = [r for r in ranks if r >= 0]
        keys = dict(zip(inside, keys_at_ranks(df, order_by, inside, limit), strict=True)) if inside else {}
        return df, [after_key(order_by, keys[r]) if r in keys else F.lit(True) for r in ranks]
    numbered = number_rows(df, order_by, "_at", nulls_last=True)
    return numbered, [F.col("_at") > r + 1 for r in ranks]


def split(
    df: DataFrame,
    share: float = 0.2,
    method: str = "random",
    key: Sequence[str] = (),
    order_by: Sequence[str] = (),
    limit: int = DIRECT_LIMIT,
) -> DataFrame:
    """Add ``is_test``. 'random' takes about the share by key hash, 'chronological' exactly the
    last ceil(n * share) rows."""
    if method == "random":
        if not key:
            raise ValueError("a random split needs key columns")
        # Hundredths where they express the share, finer steps otherwise.
        base = 100 if abs(share * 100 - round(share * 100)) < 1e-9 else 1_000_000
        return df.withColumn("is_test", key_hash(key) % base < round(share * base))
    n = df.count()
    held = math.ceil(round(n * share, 9))
    rows, (later,) = _beyond(df, order_by, [n - held - 1], limit)
    return rows.withColumn("is_test", later if held else F.lit(False)).drop("_at")


def train_test(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def folds(df: DataFrame, k: int, key: Sequence[str]) -> DataFrame:
    """Add ``fold`` in 0..k-1 by key hash, independent of the split's hash."""
    return df.withColumn("fold", (key_hash(key, "fold") % k).cast("int"))


def time_folds(df: DataFrame, k: int, order_by: Sequence[str], limit: int = DIRECT_LIMIT) -> DataFrame:
    """Add ``fold``: k test windows of n // (k + 1) rows at the end, -1 before them.

    Fold i is tested on the rows with fold = i and trained on those with fold < i.
    """
    n = df.count()
    size = n // (k + 1)
    starts = [n - (k - i) * size for i in range(k)]
    rows, tests = _beyond(df, order_by, [s - 1 for s in starts], limit)
    number = F.lit(-1)
    for later in tests:
        number = number + later.cast("int")
    return rows.withColumn("fold", number).drop("_at")


def boundary(
    df: DataFrame, share: float, order_by: Sequence[str], n: int = 3, limit: int = DIRECT_LIMIT
) -> DataFrame:
    """The last train rows and the first test rows around the cut at round(rows * (1 - share))."""
    rows = df.count()
    cut = math.floor(rows * (1 - share) + 0.5)
    frame, (later,) = _beyond(df, order_by, [cut - 1], limit)
    facts = {"train_rows": F.lit(cut).cast("bigint"), "test_rows": F.lit(rows - cut).cast("bigint")}
    down = [col(c).desc_nulls_first() for c in order_by]
    up = [col(c).asc_nulls_last() for c in order_by]
    before = frame.where(~later).orderBy(*down).limit(n).withColumn("part", F.lit("train"))
    after = frame.where(later).orderBy(*up).limit(n).withColumn("part", F.lit("test"))
    return before.unionByName(after).drop("_at").withColumns(facts)
