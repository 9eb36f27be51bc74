"""Forecasts with autoregressive and moving-average terms, many series at once.

The two-stage regression of Hannan and Rissanen on (seasonal) differences: a long autoregression gives residuals, then
least squares on lags of the differences and of those residuals gives the ARMA terms. Residuals are sums of lagged
differences, so both stages need nothing but the sums of products of lags of a series: one aggregate over the rows
serves every order, and orders are compared by AIC series by series. Full likelihood fits need many passes instead.

Orders that would not settle down (roots inside the unit circle, of either part) are left out; order (0, 0), which
carries the changes on as they are expected to be, always remains. Series too short for a long autoregression get it.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import as_number, col
from tabloom.operators.ordered import WINDOW_LIMIT, Ordered

#: Rows per coefficient of the long autoregression below which a series has no ARMA terms.
ROWS_PER_LAG = 3


def lag_sums(
    df: DataFrame, series: Sequence[str], time: Sequence[str], y: str, depth: int, season: int = 0,
    limit: int = WINDOW_LIMIT, largest: int | None = None,
) -> DataFrame:
    """Per series: ``n`` rows with ``depth`` earlier differences, ``gram`` (sums of products of the differences lagged
    0..depth, row by row), ``recent`` differences (newest first), ``last`` value and the ``cycle`` of plain changes of
    the last ``season`` rows (newest first)."""
    frame = df.select(*[col(s) for s in series], *[col(t) for t in time], as_number(df, y).alias("_y"))
    ordered = Ordered(frame.where(F.col("_y").isNotNull()), time, series, limit, largest=largest)
    reach = depth + 1 + season
    ordered.look_back(reach, lambda w: {f"_y{k}": F.lag("_y", k).over(w) for k in range(1, reach + 1)})
    y_at = [F.col("_y"), *[F.col(f"_y{k}") for k in range(1, reach + 1)]]
    change = [y_at[k] - y_at[k + 1] for k in range(reach)]
    lagged = [change[k] - change[k + season] if season else change[k] for k in range(depth + 1)]
    place = F.struct(*[col(t) for t in time])
    whole = y_at[reach].isNotNull()
    products = [F.coalesce(F.sum(F.when(whole, lagged[i] * lagged[j])), F.lit(0.0)) for i in range(depth + 1) for j in range(i, depth + 1)]
    return ordered.df.groupBy(*[col(s) for s in series]).agg(
        F.count_if(whole).alias("n"), F.array(*products).alias("gram"), F.max_by("_y", place).alias("last"),
        F.max_by(F.array(*[F.coalesce(v, F.lit(0.0)) for v in lagged]), place).alias("recent"),
        F.max_by(F.array(*[F.coalesce(v, F.lit(0.0)) for v in change[:season]]).cast("array<double>"), place).alias("cycle"),
    )


def _settles(weights: np.ndarray) -> bool:
    """Whether 1 - w1 z - w2 z^2 - ... has all its roots outside the unit circle."""
    if not len(weights):
        return True
    companion = np.zeros((len(weights), len(weights)))
    companion[0] = weights
    companion[1:, :-1] = np.eye(len(weights) - 1)
    return bool(np.abs(np.linalg.eigvals(companion)).max() < 0.999)


def fit_orders(gram: np.ndarray, n: int, long: int, p_most: int, q_most: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(AR weights, MA weights, residual variance, long autoregression) of the order with the least AIC."""
    size = len(gram)
    best = (n * np.log(max(gram[0, 0] / max(n, 1), 1e-300)) + 2, np.zeros(0), np.zeros(0), gram[0, 0] / max(n, 1))
    alone = np.zeros(long)
    if n < ROWS_PER_LAG * (long + 1) or gram[0, 0] <= 0:
        return *best[1:], alone
    alone = np.linalg.lstsq(gram[1 : long + 1, 1 : long + 1], gram[1 : long + 1, 0], rcond=1e-10)[0]
    # Rows of ``parts``: the differences at lags 0..p, then the residuals at lags 1..q, each as a sum of lagged differences.
    parts = np.zeros((1 + p_most + q_most, size))
    for k in range(p_most + 1):
        parts[k, k] = 1
    for k in range(1, q_most + 1):
        parts[p_most + k, k] = 1
        parts[p_most + k, k + 1 : k + 1 + long] -= alone
    moments = parts @ gram @ parts.T
    for p in range(p_most + 1):
        for q in range(q_most + 1):
            if p + q == 0:
                continue
            used = [*range(1, p + 1), *range(p_most + 1, p_most + 1 + q)]
            weights = np.linalg.lstsq(moments[np.ix_(used, used)], moments[used, 0], rcond=1e-10)[0]
            wrong = moments[0, 0] - 2 * weights @ moments[used, 0] + weights @ moments[np.ix_(used, used)] @ weights
            aic = n * np.log(max(wrong / n, 1e-300)) + 2 * (p + q + 1)
            if aic < best[0] and _settles(weights[:p]) and _settles(-weights[p:]):
                best = (aic, weights[:p], weights[p:], max(wrong, 0.0) / n)
    return *best[1:], alone


def carried_on(
    ar: np.ndarray, ma: np.ndarray, alone: np.ndarray, recent: np.ndarray, cycle: np.ndarray, horizon: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the expected changes up to each step, and the sum of squares that the residual variance is multiplied by."""
    p, q, season = len(ar), len(ma), len(cycle)
    residuals = [float(recent[k] - alone @ recent[k + 1 : k + 1 + len(alone)]) for k in range(q)]
    known, ahead = list(recent[:p][::-1]), []
    for h in range(horizon):
        value = sum(ar[i] * known[-1 - i] for i in range(p)) + sum(ma[j] * residuals[j - h] for j in range(h, q))
        known.append(value)
        ahead.append(value)
    changes = list(cycle[::-1])
    for h in range(horizon):
        changes.append(ahead[h] + (changes[h] if season else 0.0))
    psi: list[float] = []
    for j in range(horizon):
        weight = 1.0 if j == 0 else (ma[j - 1] if j <= q else 0.0) + sum(ar[i] * psi[j - 1 - i] for i in range(min(p, j)))
        psi.append(weight)
    seasonal = list(psi)
    for j in range(season, horizon):
        seasonal[j] += seasonal[j - season] if season else 0.0
    return np.cumsum(changes[season:]), np.cumsum(np.cumsum(seasonal) ** 2)


def forecast_arma(
    df: DataFrame, series: Sequence[str], time: Sequence[str], y: str, horizon: int = 12, season: int = 0, alpha: float = 0.05,
    ar: int = 2, ma: int = 2, long: int = 6, limit: int = WINDOW_LIMIT, largest: int | None = None,
) -> DataFrame:
    """(series, p, q, step, value, lower, upper), 4 digits: ARMA of up to ``ar`` and ``ma`` terms on first differences,
    or on differences of differences one ``season`` apart, the order chosen per series."""
    sums = lag_sums(df, series, time, y, long + ma, season, limit, largest).where(F.col("last").isNotNull())
    keys = [sums.schema[s] for s in series]
    lists = T.ArrayType(T.DoubleType())
    made = [("p", T.IntegerType()), ("q", T.IntegerType()), ("last", T.DoubleType()), ("ahead", lists), ("spread", lists)]
    schema = T.StructType([*keys, *[T.StructField(n, t) for n, t in made]])
    size, width = long + ma + 1, len(keys)
    upper = np.triu_indices(size)

    def fit(batches):
        for batch in batches:
            found = []
            n, grams, last, recent, cycle = (batch.column(width + i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                gram = np.zeros((size, size))
                gram[upper] = grams[i]
                gram = gram + np.triu(gram, 1).T
                weights, shocks, variance, alone = fit_orders(gram, n[i], long, ar, ma)
                ahead, spread = carried_on(weights, shocks, alone, np.array(recent[i]), np.array(cycle[i]), horizon)
                found.append((len(weights), len(shocks), last[i], ahead.tolist(), (variance * spread).tolist()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW, strict=True)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], *columns], schema.names)

    fitted = sums.select(*[col(s) for s in series], "n", "gram", "last", "recent", "cycle").mapInArrow(fit, schema)
    steps = fitted.select(
        *[col(s) for s in series], "p", "q", "last", F.posexplode(F.arrays_zip("ahead", "spread")).alias("_h", "_at")
    )
    z = F.lit(NormalDist().inv_cdf(1 - alpha / 2))
    value = F.col("last") + F.col("_at.ahead")
    reach = z * F.sqrt(F.col("_at.spread"))
    return steps.select(
        *[col(s) for s in series], "p", "q", (F.col("_h") + 1).alias("step"), F.round(value, 4).alias("value"),
        F.round(value - reach, 4).alias("lower"), F.round(value + reach, 4).alias("upper"),
    )


_ARROW = [pa.field(n, t) for n, t in (
    ("p", pa.int32()), ("q", pa.int32()), ("last", pa.float64()), ("ahead", pa.list_(pa.float64())), ("spread", pa.list_(pa.float64())),
)]
