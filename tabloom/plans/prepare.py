"""From a raw table to a feature table, and the same way again for new rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, col, is_numeric
from tabloom.operators import calendar as K
from tabloom.operators import encode as E
from tabloom.operators import lags as L
from tabloom.operators import moments as M
from tabloom.operators import split as D
from tabloom.operators.clean import TrainStats, fill_from, train_stats
from tabloom.operators.ordered import WINDOW_LIMIT

TOO_FEW_ROWS = 10


@dataclass(frozen=True)
class PrepareConfig:
    """Settings of a preparation. ``row_key`` breaks ties in the chronological order."""

    target: str
    features: tuple[str, ...]
    row_key: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    agg_method: str = "mean"
    agg_overrides: dict[str, str] = field(default_factory=dict)
    onehot_columns: tuple[str, ...] = ()
    periodic_columns: tuple[dict[str, Any], ...] = ()
    split_method: str = "random"
    modality: str = "tabular"
    cv_folds: int = 5
    choose_time: bool = True
    series: tuple[str, ...] = ()
    window_limit: int = WINDOW_LIMIT
    #: A one-hot column with more values becomes one sparse vector instead of a column per value.
    widest_onehot: int = E.MAX_CATEGORIES

    @property
    def chronological(self) -> bool:
        return self.split_method == "chronological" or self.modality == "forecasting"


@dataclass(frozen=True)
class Prepared:
    """What scoring needs to know: calendar columns, origins, ranges, categories, defaults.

    Categories of many values are tables (`dictionaries`), all else is small.
    """

    config: PrepareConfig
    detected: dict[str, str]
    time: E.TimeState
    ranges: dict[str, tuple[float, float]]
    categories: dict[str, list[str]]
    lag_means: dict[str, float]
    yoy_lag: int
    stats: TrainStats
    features: tuple[str, ...]
    use_combined: bool = True
    dictionaries: dict[str, E.Dictionary] = field(default_factory=dict)


#: Marks held-out rows: takes the (aggregated) frame and its order columns, returns it with a boolean ``is_test``.
Mark = Callable[[DataFrame, list[str]], DataFrame]


def _learning(frame: DataFrame) -> DataFrame:
    return frame.where(~F.col("is_test")).drop("is_test") if "is_test" in frame.columns else frame


def fit_prepare(df: DataFrame, config: PrepareConfig, mark: Mark | None = None) -> tuple[DataFrame, Prepared]:
    """Calendar numbers, aggregation, trend, cycles, waves, one-hot and lags.

    With ``mark``, held-out rows come back marked ``is_test`` and nothing is learned from them: origins, ranges,
    categories, defaults and the time choice are those of the other rows (defaults of an aggregated table are those of
    its raw rows). Lags of a held-out row read the rows before it.

    The result is one lazy plan; only origins, ranges, categories and means are computed here, and a stored table of
    numbered values for each one-hot column of many values.
    """
    detected = K.detect_calendar(df.columns)
    base = K.calendar_numeric(df, detected)
    order = [*K.chrono_keys(detected), *config.row_key]
    frame = base
    if config.group_by:
        frame = K.aggregate(base, config.group_by, config.agg_method, config.agg_overrides, order or None)
    detected = K.detect_calendar(frame.columns)
    order = [c for c in [*K.chrono_keys(detected), *config.row_key] if c in frame.columns]
    order = E.ordered_unique([*order, *[g for g in config.group_by if g not in config.series]])
    if mark:
        frame = mark(frame, E.ordered_unique([*order, *[g for g in config.group_by if g in frame.columns]]))
    stats = train_stats(base if config.group_by else _learning(frame))
    origin = E.time_state(_learning(frame), detected)
    frame = E.cyclical(E.elapsed_time(frame, detected, origin), detected)

    waves: list[str] = []
    ranges: dict[str, tuple[float, float]] = {}
    for setting in config.periodic_columns:
        name = setting.get("column")
        if name not in frame.columns:
            continue
        if setting.get("type") == "datetime":
            frame = E.periodic_datetime(frame, setting, order, config.series, config.window_limit)
        else:
            ranges.update(E.range_state(_learning(frame), [name]))
            frame = E.periodic_numeric(frame, name, ranges)
        waves += E.periodic_names(setting)

    encoded = [c for c in config.onehot_columns if c not in detected.values() and c in frame.columns]
    categories, dictionaries = E.split_categories(_learning(frame), encoded, config.widest_onehot)
    frame = E.one_hot(frame, list(categories), categories)
    for dictionary in dictionaries.values():
        frame = E.one_hot_vector(frame, dictionary)

    lags: list[str] = []
    means: dict[str, float] = {}
    yoy = L.yoy_lag_for(detected)
    if config.chronological and config.target in frame.columns and is_numeric(frame.schema[config.target].dataType):
        frame = L.lag_features(frame, config.target, order, config.series, yoy, limit=config.window_limit)
        means = {k: v or 0.0 for k, v in L.lag_means(_learning(frame)).first().asDict().items()}
        lags = list(L.LAG_COLUMNS)

    state = Prepared(config, detected, origin, ranges, categories, means, yoy, stats, (), dictionaries=dictionaries)
    combined = True
    if config.choose_time and {"year", "month"} <= detected.keys() and config.target in frame.columns:
        with_time, without = _time_choices(state, waves)
        combined = choose_time_features(_learning(frame), config.target, with_time, without, config.cv_folds, config.chronological, order)
    features = feature_list(state, waves, lags, combined)
    return frame, replace(state, features=tuple(f for f in features if f in frame.columns), use_combined=combined)


def _plain(state: Prepared) -> list[str]:
    waved = [p.get("column") for p in state.config.periodic_columns]
    left_out = {*state.categories, *state.dictionaries, *waved, *state.detected.values()}
    return [f for f in state.config.features if f not in left_out]


def feature_list(state: Prepared, waves: Sequence[str], lags: Sequence[str], combined: bool) -> list[str]:
    """Plain features, time, cycles, waves, one-hot, lags and one-hot vectors, each once, in that order."""
    time = ["elapsed_time"] if combined else [state.detected[k] for k in ("year", "month") if k in state.detected]
    if not state.detected.keys() & {"year", "month"}:
        time = []
    return E.ordered_unique(
        [*_plain(state), *time, *E.cyclical_names(state.detected), *waves, *E.one_hot_names(state.categories), *lags,
         *[d.feature for d in state.dictionaries.values()]]
    )


def _time_choices(state: Prepared, waves: Sequence[str]) -> tuple[list[str], list[str]]:
    """Both feature sets of the comparison; vectors, the same in both, are left out."""
    plain = replace(state, dictionaries={})
    left_out = set(state.dictionaries)
    return tuple([f for f in feature_list(plain, waves, (), combined) if f not in left_out] for combined in (True, False))


def choose_time_features(
    df: DataFrame, target: str, with_time: Sequence[str], without: Sequence[str], cv_folds: int, chronological: bool,
    order_by: Sequence[str],
) -> bool:
    """True when elapsed time predicts at least as well as raw year and month.

    Ridge on standardised features over at most three folds; one pass of cross products gives
    all folds of both feature sets.
    """
    if not with_time or not without or df.limit(TOO_FEW_ROWS).count() < TOO_FEW_ROWS:
        return True
    k = min(cv_folds, 3)
    marked = D.time_folds(df, k, order_by) if chronological else D.folds(df, k, order_by or df.columns)
    scores = []
    for feats in (with_time, without):
        parts = M.fold_moments(marked, feats, target, "fold")
        found = M.cv_scores(parts, lambda m: M.solve(m, 1.0, standard=True), chronological)
        scores.append(sum(found) / len(found) if found else 0.0)
    return scores[0] >= scores[1]


def apply_prepare(df: DataFrame, state: Prepared, pairs: Sequence[tuple[str, str]] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Features of new rows from the saved state; nothing is learned and no row is moved.

    A missing column or value takes the training default, the lags take their training means,
    unseen categories give 0; ``keep`` columns come through untouched. Works on a stream as well.
    """
    config = state.config
    detected = {k: c for k, c in state.detected.items() if c in state.stats.columns}
    here = {k: c for k, c in detected.items() if c in df.columns}
    frame = df.withColumns({f"_keep{i}": col(k) for i, k in enumerate(keep)}) if keep else df
    fallback = {"year": state.time.min_year, "month": state.time.min_month}
    for key, c in here.items():
        value = K.calendar_value(frame, key, c)
        if key in ("year", "month") and fallback[key] is not None:
            value = F.when(col(c).isNotNull(), value).otherwise(F.lit(fallback[key]))
        frame = frame.withColumn(c, value)
    frame = fill_from(frame, state.stats)
    frame = E.cyclical(E.elapsed_time(frame, detected, state.time), detected)
    for setting in config.periodic_columns:
        if setting.get("column") not in frame.columns:
            continue
        if setting.get("type") == "datetime":
            frame = E.periodic_datetime(frame, setting)
        else:
            frame = E.periodic_numeric(frame, setting["column"], state.ranges)
    frame = E.one_hot(frame, list(state.categories), state.categories)
    for dictionary in state.dictionaries.values():
        frame = E.one_hot_vector(frame, dictionary)
    if state.lag_means:
        frame = frame.withColumns({f"target_{k}": F.lit(v) for k, v in state.lag_means.items()})
    frame = E.add_interactions(frame, pairs)
    wanted = [*state.features, *[f"{a}_x_{b}" for a, b in pairs if f"{a}_x_{b}" not in state.features]]
    vectors = {d.feature for d in state.dictionaries.values()}
    values = [
        col(f) if f in vectors
        else F.coalesce(as_number(frame, f), F.lit(0.0)).alias(f) if f in frame.columns else F.lit(0.0).alias(f)
        for f in wanted
    ]
    return frame.select(*[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)], *values)
