"""Metrics of predictions, bootstrap intervals, bands and tiers."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, col, finite, safe_ratio
from tabloom.functions.hashing import hex_number, key_text
from tabloom.operators.quantiles import quantiles

REPLICATES = 200
PRIME = 2**31 - 1
#: Rows that are weighted at once.
RESAMPLED_ROWS = 2048


def regression_aggregates(y: Column, pred: Column, when: Column | None = None) -> dict[str, Column]:
    """Aggregate expressions for r2, rmse and mae over the rows with ``when``."""
    if when is not None:
        y, pred = F.when(when, y), F.when(when, pred)
    error = y - pred
    total = F.regr_syy(y, y)
    wrong = F.sum(error * error)
    r2 = (
        F.when(F.count(error) < 2, 0.0)
        .when(total > 0, 1 - safe_ratio(wrong, total))
        .when(wrong == 0, 1.0)
        .otherwise(0.0)
    )
    return {"r2": r2, "rmse": F.sqrt(F.avg(error * error)), "mae": F.avg(F.abs(error))}


def regression_metrics(df: DataFrame, y: str, pred: str, digits: int = 4) -> DataFrame:
    """r2, rmse and mae in one aggregate, missing -> 0."""
    parts = regression_aggregates(as_number(df, y), as_number(df, pred))
    return df.agg(*[F.coalesce(F.round(finite(v), digits), F.lit(0.0)).alias(k) for k, v in parts.items()])


def _share(y: Column, pred: Column) -> Column:
    """|error / actual| where the actual is not 0."""
    return F.when(y != 0, F.abs(safe_ratio(y - pred, y)))


def mape(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Mean absolute percentage error over actuals other than 0; 0 when there are none."""
    share = _share(as_number(df, y), as_number(df, pred))
    return df.agg(F.coalesce(F.avg(share) * 100, F.lit(0.0)).alias("mape"))


def _accuracy_terms(df: DataFrame, y: str, pred: str, task: str) -> tuple[Column, Column]:
    """Per-row numerator and denominator whose sums give a share of error (or of hits)."""
    actual, guess = as_number(df, y), as_number(df, pred)
    if task == "classification":
        return (F.bround(actual, 0) == F.bround(guess, 0)).cast("double"), F.lit(1.0)
    usable = df.where((actual != 0) & guess.isNotNull()).limit(1).count()
    if usable:
        share = _share(actual, guess)
        return F.coalesce(share, F.lit(0.0)), share.isNotNull().cast("double")
    return F.abs(actual - guess), F.abs(actual)


def _accuracy(top: Column, bottom: Column, task: str) -> Column:
    if task == "classification":
        return F.coalesce(safe_ratio(top, bottom) * 100, F.lit(0.0))
    # All actuals 0: the mean actual counts as 1.
    share = safe_ratio(top, bottom)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - share * 100)), F.lit(0.0))


def accuracy_pct(df: DataFrame, y: str, pred: str, task: str = "regression") -> DataFrame:
    """Share of equal rounded values, or 100 - MAPE kept within 0..100."""
    top, bottom = _accuracy_terms(df, y, pred, task)
    sums = df.agg(F.sum(top).alias("t"), F.sum(bottom).alias("b"), F.count(top).alias("n"))
    base = F.when(F.col("b") == 0, F.col("n").cast("double")).otherwise(F.col("b"))
    return sums.select(F.round(_accuracy(F.col("t"), base, task), 2).alias("accuracy_pct"))


def task_type(df: DataFrame, y: str, goal: str = "regression", time_based: bool = False) -> DataFrame:
    """classification by goal or with at most 10 distinct actuals, else forecasting or regression.

    A sketch rules out targets with many values first; only few values are counted exactly.
    """
    other = "forecasting" if time_based or goal == "forecasting" else "regression"
    value = as_number(df, y)
    guess = df.agg(F.approx_count_distinct(value)).first()[0]
    few = F.count_distinct(value) <= 10 if guess <= 100 else F.count(value) < 0
    return df.agg(F.when(F.lit(goal == "classification") | few, "classification").otherwise(other).alias("task_type"))


def poisson_marks(levels: int = 8, prime: int = PRIME) -> list[int]:
    """Cut points that turn a uniform number below ``prime`` into a Poisson(1) draw."""
    marks, total = [], 0.0
    for k in range(levels):
        total += math.exp(-1) / math.factorial(k)
        marks.append(math.floor(total * prime))
    return marks


def multipliers(n: int, prime: int = PRIME) -> list[int]:
    """One distinct multiplier per resample."""
    return random.Random(42).sample(range(1, prime), n)


def _weights(u: np.ndarray, v: np.ndarray, m: np.ndarray, marks: list[int]) -> np.ndarray:
    """Poisson(1) draws, one row per table row and one column per resample: how many marks (u * m + v) mod prime reaches.

    The prime is 2^31 - 1, so the remainder is the sum of the low and the high bits, taken twice.
    """
    x = u[:, None] * m + v[:, None]
    for _ in range(2):
        x = (x & PRIME) + (x >> 31)
    x[x == PRIME] = 0
    drawn = np.zeros(x.shape)
    for mark in marks:
        drawn += x >= mark
    return drawn


def bootstrap(
    df: DataFrame,
    key: Sequence[str],
    y: str,
    pred: str,
    task: str = "regression",
    level: float = 0.95,
    n: int = REPLICATES,
) -> DataFrame:
    """Accuracy with best, worst, mean and percentile bounds over n resamples.

    Resampling with replacement as Poisson(1) weights. One digest of the row key gives two
    numbers u and v below a prime; resample r draws from (u * m_r + v) mod prime, which is
    independent between rows and pairwise independent between resamples. Rows are neither moved nor
    repeated: a task adds up the sums of all resamples while it reads, and sends one row per resample.
    """
    top, bottom = _accuracy_terms(df, y, pred, task)
    digest = F.md5(key_text(key))
    rows = df.select(
        (hex_number(digest, 1, 8) % PRIME).alias("u"), (hex_number(digest, 9, 8) % PRIME).alias("v"),
        top.cast("double").alias("t"), F.coalesce(bottom.cast("double"), F.lit(0.0)).alias("b"),
    ).where(F.col("t").isNotNull())
    factors, marks = np.array(multipliers(n), np.int64), poisson_marks()

    def add_up(batches):
        sums = np.zeros((2, n))
        for batch in batches:
            u, v, t, b = (batch.column(i).to_numpy() for i in range(4))
            for start in range(0, len(u), RESAMPLED_ROWS):
                part = slice(start, start + RESAMPLED_ROWS)
                sums += np.stack((t[part], b[part])) @ _weights(u[part], v[part], factors, marks)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(sums[0]), pa.array(sums[1])], ["m", "t", "b"])

    sums = rows.mapInArrow(add_up, "m int, t double, b double").groupBy("m").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    scored = sums.select(_accuracy(F.col("t"), F.col("b"), task).alias("a"))
    tail = (1 - level) / 2
    return scored.agg(
        F.round(F.max("a"), 2).alias("ci_best"),
        F.round(F.min("a"), 2).alias("ci_worst"),
        F.round(F.avg("a"), 2).alias("ci_average"),
        F.round(F.percentile("a", F.lit(tail)), 2).alias("ci_lower"),
        F.round(F.percentile("a", F.lit(1 - tail)), 2).alias("ci_upper"),
    )


def band(metrics: DataFrame, r2: str = "r2") -> DataFrame:
    """Excellent, Good, Fair or Weak by r2."""
    value = col(r2)
    name = F.when(value >= 0.85, "Excellent").when(value >= 0.70, "Good").when(value >= 0.50, "Fair").otherwise("Weak")
    return metrics.withColumn("band", name)


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Models by r2, the best one marked; one row per model, so one small window."""
    place = F.row_number().over(Window.orderBy(F.desc("r2"), "model"))
    return metrics.withColumns({"place": place.cast("bigint"), "is_best": place == 1}).orderBy("place")


def tier_of(value: Column, low: float, high: float) -> Column:
    return F.when(value >= high, "Good").when(value >= low, "At Risk").otherwise("Poor")


def tier_bounds(df: DataFrame, basis: str) -> tuple[float, float]:
    """Quartiles of the basis column; 0 and 1 when it holds fewer than two values."""
    low, high = quantiles(df, {"b": as_number(df, basis)}, [0.25, 0.75])["b"]
    if df.where(as_number(df, basis).isNotNull()).limit(2).count() < 2:
        return 0.0, 1.0
    return low, high


def tiers(df: DataFrame, pred: str, basis: str | None = None) -> DataFrame:
    """Count and share of Poor / At Risk / Good predictions by the quartiles of the basis."""
    low, high = tier_bounds(df, basis or pred)
    counts = df.groupBy(tier_of(as_number(df, pred), low, high).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("tier", "n", F.round(100 * F.col("n") / total, 1).alias("pct"))


def residuals(df: DataFrame, y: str, pred: str) -> DataFrame:
    """actual, predicted and their difference."""
    return df.withColumns(
        {"actual": as_number(df, y), "predicted": as_number(df, pred), "residual": as_number(df, y) - as_number(df, pred)}
    )


def sample(df: DataFrame, key: Sequence[str], y: str, pred: str, n: int = 200) -> DataFrame:
    """The first n pairs by key, 4 digits."""
    keys = [col(k) for k in key]
    return (
        df.orderBy(*keys)
        .limit(n)
        .select(*keys, F.round(as_number(df, y), 4).alias("actual"), F.round(as_number(df, pred), 4).alias("predicted"))
    )
