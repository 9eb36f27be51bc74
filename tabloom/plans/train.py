"""One training run: from a raw table to compared, logged and forecasting models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import is_numeric
from tabloom.operators import calendar as K
from tabloom.operators import encode as E
from tabloom.operators import models as M
from tabloom.operators import split as D
from tabloom.operators.clean import fill_gaps, handle_missing, missing_fills
from tabloom.operators.select import Selection, run_selection
from tabloom.plans import forecast as G
from tabloom.plans.prepare import PrepareConfig, Prepared, fit_prepare
from tabloom.plans.score import Scorer
from tabloom.sources import runlog


@dataclass(frozen=True)
class TrainConfig:
    """Settings of a run beside its preparation. ``missing``: drop, mean, median or None (gaps count as 0)."""

    prepare: PrepareConfig
    models: tuple[str, ...] = ("linear", "ridge")
    missing: str | None = None
    test_share: float = 0.2
    select: bool = True
    scaling: str = "zscore"
    tune: bool = False
    trials: int = 25
    confidence: float = 0.95
    horizon: int = 12
    params: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class TrainRun:
    """What a run leaves: scorer, metrics per model, selection and, for series, forecasts."""

    scorer: Scorer
    prepared: Prepared
    trained: M.Trained
    selection: Selection | None
    features: tuple[str, ...]
    forecasts: DataFrame | None


def train(df: DataFrame, config: TrainConfig) -> TrainRun:
    """Split, gaps, preparation, selection, scaling, models, forecast.

    Rows without a target are left out. Rows are split first, and everything is learned from the training rows: fills,
    origins, categories, defaults, the time choice, selection, scaling. (The gaps of a table that is aggregated first are
    filled by the means of all its raw rows.) A random split goes by the hash of the row key, of the groups, or of the
    whole row. Chronological runs use time folds for cross-validation and tuning.
    """
    setting = config.prepare
    rows = df.where(F.col(setting.target).isNotNull())
    fill_later = config.missing in ("mean", "median") and not setting.group_by
    if config.missing and not fill_later:
        rows = handle_missing(rows, config.missing)
    method = "chronological" if setting.chronological else "random"
    key: list[str] = []

    def mark(frame: DataFrame, order: list[str]) -> DataFrame:
        key.extend([c for c in setting.row_key or setting.group_by if c in frame.columns] or frame.columns)
        marked = D.split(frame, config.test_share, method, key=key, order_by=order)
        if fill_later:
            marked = fill_gaps(marked, missing_fills(D.train_test(marked)[0], config.missing))
        return marked

    frame, state = fit_prepare(rows, setting, mark)
    order = _order(frame, setting)
    train_rows, test_rows = D.train_test(frame)
    frame = frame.drop("is_test")

    features, pairs, selection = state.features, (), None
    if config.select:
        selection = run_selection(train_rows, features, setting.target)
        features, pairs = _chosen(selection)
        # Vectors of categories have no single variance or correlation; they stay.
        features = (*features, *[d.feature for d in state.dictionaries.values()])
        train_rows, test_rows = E.add_interactions(train_rows, pairs), E.add_interactions(test_rows, pairs)
    state = replace(state, features=tuple(f for f in features if f not in {f"{a}_x_{b}" for a, b in pairs}))
    fold = None
    if setting.chronological:
        train_rows, fold = D.time_folds(train_rows, setting.cv_folds, order), "fold"
    scaler = E.fit_scaler(train_rows, features, config.scaling)
    settings = M.TrainSettings(
        key=tuple(key), cv_folds=setting.cv_folds, time_based=setting.chronological, confidence=config.confidence,
        tune=config.tune, trials=config.trials, params=config.params, fold=fold,
    )
    trained = M.train_models(scaler.apply(train_rows), scaler.apply(test_rows), features, setting.target, list(config.models), settings)
    ahead = None
    times = [c for c in K.chrono_keys(state.detected) if c in frame.columns]
    if setting.modality == "forecasting" and times and is_numeric(frame.schema[setting.target].dataType):
        ahead = _forecasts(frame, setting, times, config.horizon)
    return TrainRun(Scorer.of(state, scaler, trained, pairs), state, trained, selection, tuple(features), ahead)


def _order(frame: DataFrame, setting: PrepareConfig) -> list[str]:
    detected = K.detect_calendar(frame.columns)
    wanted = [*K.chrono_keys(detected), *setting.row_key, *setting.group_by]
    return [c for c in E.ordered_unique(wanted) if c in frame.columns]


def _chosen(selection: Selection) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
    """The selected features and the pairs that the selected products are made of."""
    products = {f"{a}_x_{b}": (a, b) for a, b in selection.pairs}
    return selection.selected, tuple(products[f] for f in selection.selected if f in products)


def _forecasts(frame: DataFrame, setting: PrepareConfig, times: Sequence[str], horizon: int) -> DataFrame:
    """Total of the target per time and series, carried on by the straight-line and the autoregressive forecast."""
    series = [s for s in setting.series if s in frame.columns]
    totals = frame.groupBy(*series, *times).agg(F.sum(setting.target).alias("y"))
    made = {"linear": G.forecast_linear(totals, series, times, "y", horizon), "ar": G.forecast_ar(totals, series, times, "y", horizon)}
    return G.forecast_table(made, "ar", series)


def log_run(run: TrainRun, path: str, dataset: str, config: TrainConfig, user: str | None = None) -> None:
    """The run's models appended to the run log."""
    setting = config.prepare
    facts = {"split": config.test_share, "missing": config.missing, "scaling": config.scaling, "select": config.select}
    rows = runlog.run_rows(run.trained.metrics, dataset, setting.target, len(run.features), facts, setting.modality, user)
    runlog.append_runs(rows, path)
