"""Lag and rolling features of the target in chronological order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tabloom.functions.columns import as_number, safe_ratio
from tabloom.operators.ordered import BLOCK_ROWS, WINDOW_LIMIT, Ordered

LAG_COLUMNS = (
    "target_lag_1",
    "target_lag_yoy",
    "target_yoy_growth",
    "target_rolling_mean_3",
    "target_rolling_mean_yoy",
)

# A series of calendar months or coarser buckets of the years 1-9999 cannot be longer.
MONTH_SERIES_BOUND = 12 * 9999


def yoy_lag_for(detected: dict[str, str]) -> int:
    """Rows per year by the finest calendar key that is present."""
    if "month" in detected:
        return 12
    if "week" in detected:
        return 52
    if "quarter" in detected:
        return 4
    return 12


def lag_features(
    df: DataFrame,
    target: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    yoy_lag: int = 12,
    backfill: bool = True,
    columns: Sequence[str] = LAG_COLUMNS,
    largest: int | None = None,
    limit: int = WINDOW_LIMIT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Previous value, value a year ago, yearly growth and rolling means of earlier values.

    ``backfill`` gives gaps the next known value; the
    first row then sees its own target. Without it gaps are 0. ``largest`` states a known
    bound on the rows per series and saves the count.
    """
    k = yoy_lag
    frame = df.withColumn("_y", as_number(df, target))

    def make(w: WindowSpec) -> dict[str, Column]:
        y = F.col("_y")
        previous, year_before = F.lag(y, 1).over(w), F.lag(y, k + 1).over(w)
        made = {
            "target_lag_1": previous,
            "target_lag_yoy": F.lag(y, k).over(w),
            "target_yoy_growth": safe_ratio(previous - year_before, year_before + F.lit(1e-8)),
            "target_rolling_mean_3": F.avg(y).over(w.rowsBetween(-3, -1)),
            "target_rolling_mean_yoy": F.avg(y).over(w.rowsBetween(-k, -1)),
        }
        return {c: made[c] for c in columns}

    ordered = Ordered(frame, order_by, partition_by, limit, block_rows, largest)
    ordered.look_back(k + 1, make)
    for c in columns:
        if backfill and c != "target_yoy_growth":
            ordered.fill(c, c, forward=False)
    ordered.with_columns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})
    return ordered.rows().drop("_y")


def lag_means(df: DataFrame) -> DataFrame:
    """Means of the lag features: the defaults for scoring rows without history."""
    short = {c: c.removeprefix("target_") for c in LAG_COLUMNS}
    return df.agg(*[F.avg(c).alias(name) for c, name in short.items()])
