"""Forecasts of many series at once, in closed form per series.

The autoregressive forecasts stand in for full-likelihood ARIMA fits: conditional least
squares on (seasonal) differences, so each needs only sums per series.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, col, safe_ratio
from tabloom.operators.models import fit_linear
from tabloom.operators.ordered import WINDOW_LIMIT, Ordered

RECENT = 10
#: Autoregressive weights are kept within +/- this value unless told otherwise, so that forecasts cannot grow without bound.
STEADY = 0.99


def _steps(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def _rounded(df: DataFrame, series: Sequence[str]) -> DataFrame:
    return df.select(
        *[col(s) for s in series], "step", *[F.round(c, 4).alias(c) for c in ("value", "lower", "upper")]
    )


def recent_rows(df: DataFrame, series: Sequence[str], time: Sequence[str], n: int) -> DataFrame:
    """The last n rows per series; ranks are cut per task before the shuffle."""
    down = [col(t).desc() for t in time]
    if not series:
        return df.orderBy(*down).limit(n)
    place = F.row_number().over(Window.partitionBy(*[col(s) for s in series]).orderBy(*down))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def forecast_linear(
    df: DataFrame, series: Sequence[str], time: Sequence[str], y: str, horizon: int = 12
) -> DataFrame:
    """Straight line through the last value with the slope of the last ten; the band widens by step."""
    frame = df.withColumn("_y", as_number(df, y)).where(F.col("_y").isNotNull())
    place = F.struct(*[col(t) for t in time])
    ends = (
        recent_rows(frame, series, time, RECENT)
        .groupBy(*[col(s) for s in series])
        .agg(F.count("_y").alias("n"), F.max_by("_y", place).alias("last"), F.min_by("_y", place).alias("first"))
        .where(F.col("n") > 0)
    )
    slope = F.coalesce(safe_ratio(F.col("last") - F.col("first"), F.col("n") - 1), F.lit(0.0))
    stepped = _steps(ends.withColumn("slope", slope), horizon)
    value = F.greatest(F.lit(0.0), F.col("last") + F.col("slope") * F.col("step"))
    stepped = stepped.withColumn("value", value)
    unsure = 0.05 * F.col("value") + 0.02 * F.col("step") * F.col("value")
    bands = {"lower": F.greatest(F.lit(0.0), F.col("value") - unsure), "upper": F.col("value") + unsure}
    return _rounded(stepped.withColumns(bands), series)


def forecast_compound(base: DataFrame, value: str, steps: int = 10) -> DataFrame:
    """One percent of the base value more per step."""
    stepped = _steps(base, steps)
    grown = as_number(stepped, value) * (1 + F.lit(0.01) * F.col("step"))
    return stepped.select("step", F.round(grown, 4).alias("value"))


def _steady(phi: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(phi, F.lit(0.0))))


def _rise(phi: Column, j: Column) -> Column:
    """1 + phi + ... + phi^j."""
    return (1 - F.pow(phi, j + 1)) / (1 - phi)


def _ar_sums(ordered: Ordered, series: Sequence[str], change: str, before: str, steady: float) -> DataFrame:
    """phi and residual variance of a zero-mean AR(1) on ``change``, with the last value and change."""
    d, p = F.col(change), F.col(before)
    both = p.isNotNull() & d.isNotNull()
    place = F.struct(*[col(t) for t in ordered.order_by])
    sums = ordered.df.groupBy(*[col(s) for s in series]).agg(
        F.count_if(both).alias("m"),
        F.sum(F.when(both, d * p)).alias("dp"),
        F.sum(F.when(both, p * p)).alias("pp"),
        F.sum(F.when(both, d * d)).alias("dd"),
        F.max_by("_y", place).alias("last"),
        F.coalesce(F.max_by(change, place), F.lit(0.0)).alias("last_change"),
    )
    phi = _steady(safe_ratio(F.col("dp"), F.col("pp")), steady)
    fitted = sums.withColumn("phi", phi)
    wrong = F.col("dd") - 2 * F.col("phi") * F.col("dp") + F.col("phi") * F.col("phi") * F.col("pp")
    return fitted.withColumn(
        "sigma2", F.greatest(F.coalesce(safe_ratio(wrong, F.col("m")), F.lit(0.0)), F.lit(0.0))
    )


def _interval(df: DataFrame, alpha: float, variance: Column) -> DataFrame:
    z = NormalDist().inv_cdf(1 - alpha / 2)
    reach = F.lit(z) * F.sqrt(variance)
    return df.withColumns({"lower": F.col("value") - reach, "upper": F.col("value") + reach})


def forecast_ar(
    df: DataFrame, series: Sequence[str], time: Sequence[str], y: str, horizon: int = 12, alpha: float = 0.05,
    limit: int = WINDOW_LIMIT, largest: int | None = None, steady: float = STEADY,
) -> DataFrame:
    """AR(1) on first differences per series, rolled forward."""
    frame = df.select(*[col(s) for s in series], *[col(t) for t in time], as_number(df, y).alias("_y"))
    ordered = Ordered(frame.where(F.col("_y").isNotNull()), time, series, limit, largest=largest)
    ordered.look_back(
        2,
        lambda w: {
            "_d": F.col("_y") - F.lag("_y", 1).over(w),
            "_p": F.lag("_y", 1).over(w) - F.lag("_y", 2).over(w),
        },
    )
    stepped = _steps(_ar_sums(ordered, series, "_d", "_p", steady), horizon)
    phi, h = F.col("phi"), F.col("step")
    # phi + ... + phi^h
    value = F.col("last") + F.col("last_change") * (_rise(phi, h) - 1)
    spread = F.aggregate(
        F.transform(F.sequence(F.lit(0), h - 1), lambda j: F.pow(_rise(phi, j), F.lit(2))), F.lit(0.0), lambda a, x: a + x
    )
    return _rounded(_interval(stepped.withColumn("value", value), alpha, F.col("sigma2") * spread), series)


def forecast_seasonal_ar(
    df: DataFrame, series: Sequence[str], time: Sequence[str], y: str, horizon: int = 12, season: int = 12,
    alpha: float = 0.05, limit: int = WINDOW_LIMIT, largest: int | None = None, steady: float = STEADY,
) -> DataFrame:
    """AR(1) on differences of differences one season apart, added back up.

    A series with fewer changes than a season repeats those it has (none: it stays level at its last value)."""
    frame = df.select(*[col(s) for s in series], *[col(t) for t in time], as_number(df, y).alias("_y"))
    frame = frame.where(F.col("_y").isNotNull())
    ordered = Ordered(frame, time, series, limit, largest=largest)

    def make(w):
        def change(k):
            return F.lag("_y", k).over(w) - F.lag("_y", k + 1).over(w) if k else F.col("_y") - F.lag("_y", 1).over(w)
        return {"_d": change(0), "_w": change(0) - change(season), "_p": change(1) - change(season + 1)}

    ordered.look_back(season + 2, make)
    sums = _ar_sums(ordered, series, "_w", "_p", steady)
    # Differences of the last season, oldest first; at most `season` per series.
    recent = recent_rows(ordered.df.where(F.col("_d").isNotNull()), series, time, season)
    place = F.struct(*[col(t) for t in time])
    pattern = recent.groupBy(*[col(s) for s in series]).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(place.alias("t"), F.col("_d").alias("d")))), lambda x: x["d"]).alias("ds")
    )
    # Null series are series too; a series shorter than a season repeats the changes that it has, or stays level.
    named = pattern.select(*[col(c).alias(f"_s{i}") for i, c in enumerate(series)], "ds")
    same = F.lit(True)
    for i, c in enumerate(series):
        same = same & col(c).eqNullSafe(F.col(f"_s{i}"))
    joined = sums.join(named, same, "left").drop(*[f"_s{i}" for i in range(len(series))])
    short = F.transform(
        F.sequence(F.lit(0), F.lit(season - 1)), lambda j: F.coalesce(F.get("ds", F.pmod(j, F.size("ds"))), F.lit(0.0))
    )
    joined = joined.withColumn("ds", F.when(F.size("ds") == season, F.col("ds")).otherwise(short))
    if not series:
        joined = joined.where(F.col("last").isNotNull())
    phi = F.col("phi")

    def change_at(i: Column) -> Column:
        """Forecast change i steps ahead: last season's change plus the decaying AR terms."""
        laps = F.sequence(F.lit(0), F.floor((i - 1) / season).cast("int"))
        terms = F.transform(laps, lambda k: F.pow(phi, i - k * season) * F.col("last_change"))
        return F.element_at("ds", ((i - 1) % season + 1).cast("int")) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    def weight(j: Column) -> Column:
        laps = F.sequence(F.lit(0), F.floor(j / season).cast("int"))
        return F.aggregate(F.transform(laps, lambda k: _rise(phi, j - k * season)), F.lit(0.0), lambda a, x: a + x)

    stepped = _steps(joined, horizon)
    h = F.col("step")
    rise = F.aggregate(F.transform(F.sequence(F.lit(1), h), change_at), F.lit(0.0), lambda a, x: a + x)
    spread = F.aggregate(
        F.transform(F.sequence(F.lit(0), h - 1), lambda j: F.pow(weight(j), F.lit(2))), F.lit(0.0), lambda a, x: a + x
    )
    made = stepped.withColumn("value", F.col("last") + rise)
    return _rounded(_interval(made, alpha, F.col("sigma2") * spread), series)


def forecast_exog(
    df: DataFrame, series: Sequence[str], time: Sequence[str], y: str, features: Sequence[str], horizon: int = 12,
    alpha: float = 0.05, limit: int = WINDOW_LIMIT, largest: int | None = None, steady: float = STEADY,
) -> DataFrame:
    """Previous value plus outside features, fitted over all series; future features stay at their mean.

    A weight of the previous value beyond ``steady`` is set to it, and the rest is fitted again beside it.
    """
    if not features:
        raise ValueError("an outside feature is needed: choose feature columns")
    slim = df.select(*[col(c) for c in dict.fromkeys([*series, *time, *features])], as_number(df, y).alias("_y"))
    ordered = Ordered(slim.where(F.col("_y").isNotNull()), time, series, limit, largest=largest)
    ordered.look_back(1, lambda w: {"target_lag_1": F.lag("_y", 1).over(w)})
    lagged = ordered.rows()
    place = F.struct(*[col(t) for t in time])
    # Only the first row of a series has no previous value.
    train = lagged.where(F.col("target_lag_1").isNotNull())
    feats = ["target_lag_1", *features]
    fitted = fit_linear(train, feats, "_y")
    phi, *betas = [float(b) for b in fitted.model.coefficients]
    if abs(phi) > steady:
        phi = max(-steady, min(steady, phi))
        train = train.withColumn("_y", F.col("_y") - F.lit(phi) * F.col("target_lag_1"))
        fitted = fit_linear(train, list(features), "_y")
        betas = [float(b) for b in fitted.model.coefficients]
    means = train.agg(*[F.avg(F.coalesce(as_number(train, f), F.lit(0.0))).alias(f"m{i}") for i, f in enumerate(features)]).first()
    drift = float(fitted.model.intercept) + sum(b * (means[f"m{i}"] or 0.0) for i, b in enumerate(betas))
    scored = fitted.predict(train, "_guess")
    error = F.col("_y") - F.col("_guess")
    variance = scored.agg(F.avg(error * error)).first()[0] or 0.0
    last = lagged.groupBy(*[col(s) for s in series]).agg(F.max_by("_y", place).alias("last"))
    stepped = _steps(last, horizon)
    power = F.pow(F.lit(phi), F.col("step"))
    value = power * F.col("last") + F.lit(drift) * (1 - power) / F.lit(1 - phi)
    spread = (1 - power * power) / F.lit(1 - phi * phi)
    return _rounded(_interval(stepped.withColumn("value", value), alpha, F.lit(variance) * spread), series)


def forecast_table(forecasts: dict[str, DataFrame], best: str, series: Sequence[str] = ()) -> DataFrame:
    """One row per step: value, worst, average and best case of each model, the best model's up front."""
    long = None
    for model, frame in forecasts.items():
        one = frame.select(*[col(s) for s in series], "step", "value", "lower", "upper", F.lit(model).alias("model"))
        long = one if long is None else long.unionByName(one)

    def of(model: str, column: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column)))

    aggs = [
        of(best, "value").alias("value"), of(best, "value").alias("average_case"),
        of(best, "lower").alias("worst_case"), of(best, "upper").alias("best_case"),
    ]
    for model in forecasts:
        aggs += [
            of(model, "value").alias(model), of(model, "value").alias(f"{model}_average"),
            of(model, "lower").alias(f"{model}_worst"), of(model, "upper").alias(f"{model}_best"),
        ]
    return long.groupBy(*[col(s) for s in series], "step").agg(*aggs)
