"""Scoring of new rows and summaries of the scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, col, finite
from tabloom.operators import evaluate as V
from tabloom.operators.encode import Scaler
from tabloom.operators.models import Fitted, Trained
from tabloom.plans.prepare import Prepared, apply_prepare


@dataclass(frozen=True)
class Scorer:
    """Preparation, scaling and models that belong together."""

    prepared: Prepared
    scaler: Scaler
    models: dict[str, Fitted]
    best: str
    pairs: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def of(prepared: Prepared, scaler: Scaler, trained: Trained, pairs: Sequence[tuple[str, str]] = ()) -> Scorer:
        return Scorer(prepared, scaler, trained.models, trained.best, tuple(pairs))

    def pick(self, name: str | None) -> Fitted:
        """The named model, else the best one."""
        return self.models.get(name) or self.models[self.best]


def score(df: DataFrame, scorer: Scorer, model: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for raw rows, 4 digits; NaN and infinities become 0."""
    ready = scorer.scaler.apply(apply_prepare(df, scorer.prepared, scorer.pairs, keep))
    scored = scorer.pick(model).predict(ready)
    return scored.select(*[col(k) for k in keep], F.round("prediction", 4).alias("prediction"))


def score_summary(
    scored: DataFrame, pred: str = "prediction", population: bool = False, model: str = "model"
) -> DataFrame:
    """mean, std, min, max and count of the finite predictions, 4 digits."""
    value = finite(as_number(scored, pred))
    spread = F.stddev_pop(value) if population else F.stddev_samp(value)
    def shown(v):
        return F.coalesce(F.round(v, 4), F.lit(0.0))
    return scored.agg(
        shown(F.avg(value)).alias("mean"), shown(spread).alias("std"), shown(F.min(value)).alias("min"),
        shown(F.max(value)).alias("max"), F.count(value).alias("count"),
    ).select(F.lit(model).alias("model"), "mean", "std", "min", "max", "count")


def score_tiers(scored: DataFrame, train: DataFrame, target: str, pred: str = "prediction") -> DataFrame:
    """Poor / At Risk / Good counts of predictions by the quartiles of the training target."""
    low, high = V.tier_bounds(train, target)
    counts = scored.groupBy(V.tier_of(as_number(scored, pred), low, high).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    total = scored.count()
    return counts.select("tier", "n", F.round(100 * F.col("n") / F.lit(max(total, 1)), 1).alias("pct"))


def score_models(df: DataFrame, scorer: Scorer, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, model, prediction): every model's prediction for every row, prepared and scaled once."""
    frame = scorer.scaler.apply(apply_prepare(df, scorer.prepared, scorer.pairs, keep))
    names = list(scorer.models)
    for i, name in enumerate(names):
        frame = scorer.models[name].predict(frame, f"_p{i}")
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_p{i}").alias("prediction")) for i, n in enumerate(names)])
    return frame.select(*[col(k) for k in keep], F.inline(rows))


def batch_summary(df: DataFrame, scorer: Scorer, basis: DataFrame, target: str) -> DataFrame:
    """One row per model over new rows: mean, population deviation, min, max, count, and count and share of the
    predictions in each tier by the quartiles of ``target`` in ``basis``."""
    low, high = V.tier_bounds(basis, target)
    value = F.col("prediction")
    tier = V.tier_of(value, low, high)
    rows = score_models(df, scorer)
    aggs = [f(value).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    names = {"poor": "Poor", "at_risk": "At Risk", "good": "Good"}
    counted = rows.groupBy("model").agg(*aggs, F.count(value).alias("count"), *[F.count_if(tier == t).alias(n) for n, t in names.items()])
    shares = [F.round(100 * F.col(n) / F.greatest(F.col("count"), F.lit(1)), 1).alias(f"{n}_pct") for n in names]
    return counted.select("model", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "count", *names, *shares)


def batch_sample(df: DataFrame, scorer: Scorer, order_by: Sequence[str], n: int = 20) -> DataFrame:
    """(keys, model, prediction) of the first n rows in a stated order, 4 digits."""
    first = df.orderBy(*[col(c) for c in order_by]).limit(n)
    return score_models(first, scorer, order_by).withColumn("prediction", F.round("prediction", 4))
