"""Regressors, their search ranges, tuning, cross-validation and comparison."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import as_number, col, finite
from tabloom.functions.vectors import is_vector
from tabloom.operators import boosting
from tabloom.operators import cells as C
from tabloom.operators import evaluate as V
from tabloom.operators import moments as M
from tabloom.operators.boosting import TargetStatistics, ordered_statistics
from tabloom.operators.encode import assemble
from tabloom.operators.profile import target_correlations
from tabloom.operators.split import folds as assign_folds
from tabloom.session import shared_dir

SEED = 42
#: Levels of a forest without a depth limit: the most that Spark trees can have.
DEEPEST = 30
#: The most cells of all resamples of a forest, which a task adds up in memory.
DRAWN_CELLS = 1_000_000


@dataclass(frozen=True)
class Fitted:
    """A trained model with the features it reads, in order."""

    name: str
    model: Any
    features: tuple[str, ...]
    params: dict[str, Any] = field(default_factory=dict)
    #: Statistics of text columns that the features are made of.
    statistics: tuple[TargetStatistics, ...] = ()
    #: Cut points of the features that the model reads as numbers of bins.
    cuts: dict[str, list[float]] = field(default_factory=dict)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add a prediction column; NaN and infinities become 0."""
        frame = df
        for statistic in self.statistics:
            frame = statistic.apply(frame)
        frame, read = C.binned(frame, self.features, self.cuts)
        scored = self.model.setPredictionCol("_p").transform(assemble(frame, read, "_v"))
        scored = scored.drop(*[s.feature for s in self.statistics], *set(read).difference(self.features))
        return scored.withColumn(out, F.coalesce(finite(F.col("_p")), F.lit(0.0))).drop("_p", "_v")


def training_frame(df: DataFrame, feats: Sequence[str], y: str) -> DataFrame:
    """Feature vector and label, gaps as 0."""
    return assemble(df, feats, "_v").select("_v", F.coalesce(as_number(df, y), F.lit(0.0)).alias("_y"))


def _columns(estimator):
    return estimator.setFeaturesCol("_v").setLabelCol("_y")


def fit_linear(train: DataFrame, feats: Sequence[str], y: str) -> Fitted:
    """Ordinary least squares by normal equations (one pass)."""
    estimator = _columns(LinearRegression(regParam=0.0, solver="auto"))
    return Fitted("linear", estimator.fit(training_frame(train, feats, y)), tuple(feats))


def fit_ridge(train: DataFrame, feats: Sequence[str], y: str, alpha: float = 1.0) -> Fitted:
    """Least squares plus alpha * |coefficients|^2.

    Spark divides the loss by the row count and the label by its deviation, so the penalty is
    alpha * deviation / rows.
    """
    frame = training_frame(train, feats, y)
    row = frame.agg(F.stddev_pop("_y").alias("d"), F.count("_y").alias("n")).first()
    penalty = alpha * (row["d"] or 0.0) / max(row["n"], 1)
    estimator = LinearRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, solver="auto")
    return Fitted("ridge", _columns(estimator).fit(frame), tuple(feats), {"alpha": alpha})


def fit_tree(train: DataFrame, feats: Sequence[str], y: str, max_depth: int = 8, min_split: int = 2) -> Fitted:
    least = max(1, min_split // 2)
    made = C.cells(train, feats, y)
    if made is None:
        estimator = DecisionTreeRegressor(maxDepth=max_depth, minInstancesPerNode=least, seed=SEED)
        model = _columns(estimator).fit(training_frame(train, feats, y))
    else:
        estimator = DecisionTreeRegressor(weightCol="_n", seed=SEED, **C.leaves(made, least, max_depth))
        model = _columns(estimator).fit(C.weighted(made, feats))
    return Fitted("dt", model, tuple(feats), {"max_depth": max_depth, "min_split": min_split})


def fit_forest(
    train: DataFrame, feats: Sequence[str], y: str, trees: int = 100, max_depth: int | None = None,
    min_split: int = 2, max_features: str = "sqrt",
) -> Fitted:
    """Random forest; 'no depth limit' means ``DEEPEST`` levels.

    Spark bounds leaves and not splits: a node of ``min_split`` rows may split if both halves hold min_split // 2.
    Where features repeat, the rows of every resample are added up per cell in one pass, and each tree is fitted to its cells.
    """
    least, depth = max(1, min_split // 2), max_depth or DEEPEST
    made = C.cells(train, feats, y)
    if made is None or made.count() * trees > DRAWN_CELLS:
        estimator = RandomForestRegressor(
            numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy=max_features, bootstrap=True, seed=SEED,
        )
        model = _columns(estimator).fit(training_frame(train, feats, y))
    else:
        drawn = C.drawn_cells(train, feats, y, made, trees, SEED)
        model = boosting.fit_trees(assemble(drawn, feats, "_v").select("_v", "_y", "_n", "tree"), trees, least, depth, max_features, SEED)
    params = {"trees": trees, "max_depth": max_depth, "min_split": min_split, "max_features": max_features}
    return Fitted("rf", model, tuple(feats), params)


# Boosting presets (trees, learning rate) and the settings of related boosters.
PRESETS = {
    "simple": {"trees": 50, "learning_rate": 0.15},
    "balanced": {"trees": 100, "learning_rate": 0.10},
    "advanced": {"trees": 200, "learning_rate": 0.05},
}
BOOSTERS = {
    "gbm": {"trees": 100, "learning_rate": 0.1, "max_depth": 3, "subsample": 1.0},
    "xgboost": {"trees": 100, "learning_rate": 0.1, "max_depth": 6, "subsample": 1.0, "column_share": 1.0},
    "lgbm": {"trees": 100, "learning_rate": 0.1, "leaves": 31, "subsample": 1.0},
    "catboost": {"trees": 100, "learning_rate": 0.1, "max_depth": 6},
}


def fit_boosting(
    train: DataFrame, feats: Sequence[str], y: str, preset: str | None = None, booster: str = "gbm", key: Sequence[str] = (),
    **params,
) -> Fitted:
    """Gradient-boosted trees. Presets set trees and rate; a leaf count becomes a depth.

    The catboost setting takes text features as well: each becomes the mean target of earlier rows of its text, in the
    order of a hash of ``key`` (of the whole row without one, where equal rows count as one place), and for new rows
    the mean of all training rows. Such means hardly repeat, so the trees read cells of the bins that Spark's trees tell
    apart; what is equal in all bins is one row to them.
    """
    shared_dir(train.sparkSession)  # long lineages are cut at the checkpoint interval
    statistics = []
    if booster == "catboost":
        texts = [f for f in feats if isinstance(train.schema[f].dataType, T.StringType)]
        for text in texts:
            train, made = ordered_statistics(train, text, y, list(key) or train.columns)
            statistics.append(made)
            feats = [made.feature if f == text else f for f in feats]
    chosen = {**BOOSTERS[booster], **(PRESETS[preset] if preset else {}), **params}
    depth = chosen.get("max_depth") or max(2, math.ceil(math.log2(chosen.get("leaves", 8))))
    estimator = GBTRegressor(
        maxIter=chosen["trees"], stepSize=chosen["learning_rate"], maxDepth=depth,
        subsamplingRate=chosen.get("subsample", 1.0), seed=SEED,
        featureSubsetStrategy=str(chosen["column_share"]) if chosen.get("column_share", 1.0) < 1.0 else "all",
    )
    if not statistics:
        return _boosted(estimator, train, feats, y, booster, chosen)
    # What makes the statistics, a sort of all rows, runs once.
    slim = train.select(*[col(c) for c in dict.fromkeys([*feats, y])]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _boosted(estimator, slim, feats, y, booster, chosen, tuple(statistics))
    finally:
        slim.unpersist()


def _boosted(
    estimator: GBTRegressor, train: DataFrame, feats: Sequence[str], y: str, booster: str, chosen: dict[str, Any],
    statistics: tuple[TargetStatistics, ...] = (),
) -> Fitted:
    # A share of the rows is drawn anew for every tree and cannot be taken of cells.
    whole, cuts, read, made = chosen.get("subsample", 1.0) == 1.0, {}, list(feats), None
    if whole and statistics and _all_numbers(train, feats):
        cuts = C.cut_points(train, [f for f in feats if "ml_attr" not in train.schema[f].metadata], estimator.getMaxBins())
        told, read = C.binned(train, feats, cuts)
        made = C.cells(told, read, y)
        if made is None:
            cuts, read = {}, list(feats)
    elif whole:
        made = C.cells(train, feats, y)
    frame = training_frame(train, feats, y) if made is None else C.weighted(made, read)
    estimator = _columns(estimator if made is None else estimator.setWeightCol("_n"))
    return Fitted(booster, estimator.fit(frame), tuple(feats), chosen, statistics, cuts)


def fit_adaboost(
    train: DataFrame, feats: Sequence[str], y: str, trees: int = 100, learning_rate: float = 0.1, max_depth: int = 4
) -> Fitted:
    """AdaBoost.R2: trees on reweighted rows, the weighted median of their predictions."""
    made = C.cells(train, feats, y)
    if made is None:
        model = boosting.fit_adaboost(training_frame(train, feats, y), trees, learning_rate, max_depth, SEED)
    else:
        rows = train.select(*C.numbers(train, feats), F.coalesce(as_number(train, y), F.lit(0.0)).alias("_y"))
        rows = rows.select(C.place(feats).alias("_at"), "_y")
        known = assemble(made.select(*feats).distinct(), feats, "_v").select(C.place(feats).alias("_at"), "_v")
        model = boosting.fit_adaboost_cells(rows, known, trees, learning_rate, max_depth, SEED)
    params = {"trees": trees, "learning_rate": learning_rate, "max_depth": max_depth}
    return Fitted("adaboost", model, tuple(feats), params)


Draw = Callable[[random.Random], Any]


def _log_between(low: float, high: float) -> Draw:
    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


def _whole(low: int, high: int) -> Draw:
    return lambda rng: rng.randint(low, high)


def _between(low: float, high: float) -> Draw:
    return lambda rng: rng.uniform(low, high)


def _one_of(*values) -> Draw:
    return lambda rng: rng.choice(values)


@dataclass(frozen=True)
class ModelSpec:
    """How to fit a model and where its parameters are searched; no ranges, no search."""

    fit: Callable[..., Fitted]
    ranges: dict[str, Draw] = field(default_factory=dict)
    fixed: dict[str, Any] = field(default_factory=dict)


MODELS: dict[str, ModelSpec] = {}


def register_model(name: str, spec: ModelSpec) -> None:
    """Make a model available by name."""
    MODELS[name] = spec


register_model("linear", ModelSpec(fit_linear))
register_model("ridge", ModelSpec(fit_ridge, {"alpha": _log_between(1e-3, 1e2)}))
register_model("dt", ModelSpec(fit_tree, {"max_depth": _whole(3, 20), "min_split": _whole(2, 20)}))
register_model(
    "rf",
    ModelSpec(
        fit_forest,
        {
            "trees": _whole(50, 400), "max_depth": _whole(3, 20), "min_split": _whole(2, 20),
            "max_features": _one_of("sqrt", "log2"),
        },
    ),
)
register_model(
    "gbm",
    ModelSpec(
        fit_boosting,
        {
            "trees": _whole(50, 400), "learning_rate": _log_between(1e-3, 0.3), "max_depth": _whole(2, 8),
            "subsample": _between(0.6, 1.0),
        },
        {"booster": "gbm"},
    ),
)
register_model(
    "xgboost",
    ModelSpec(
        fit_boosting,
        {
            "trees": _whole(50, 500), "learning_rate": _log_between(1e-3, 0.3), "max_depth": _whole(2, 8),
            "subsample": _between(0.6, 1.0), "column_share": _between(0.5, 1.0),
        },
        {"booster": "xgboost"},
    ),
)
register_model(
    "lgbm",
    ModelSpec(
        fit_boosting,
        {
            "trees": _whole(50, 500), "learning_rate": _log_between(1e-3, 0.3), "leaves": _whole(15, 127),
            "subsample": _between(0.6, 1.0),
        },
        {"booster": "lgbm"},
    ),
)
register_model(
    "catboost",
    ModelSpec(
        fit_boosting,
        {"trees": _whole(50, 400), "learning_rate": _log_between(1e-3, 0.3), "max_depth": _whole(3, 10)},
        {"booster": "catboost"},
    ),
)


register_model("adaboost", ModelSpec(fit_adaboost, {"trees": _whole(50, 300), "learning_rate": _log_between(1e-2, 1.5)}))


def fit_model(train: DataFrame, feats: Sequence[str], y: str, name: str, params: dict[str, Any] | None = None) -> Fitted:
    if name not in MODELS:
        raise ValueError(f"model {name!r} is not registered")
    spec = MODELS[name]
    return spec.fit(train, feats, y, **{**spec.fixed, **(params or {})})


#: Models that weigh or draw single rows.
ROW_MODELS = ("rf", "adaboost")


def _takes_cells(name: str, params: dict[str, Any] | None) -> bool:
    """Whether the model is one of trees over numbers that cells can be given to instead of rows."""
    if name == "dt":
        return True
    if name not in BOOSTERS or name not in MODELS or MODELS[name].fit is not fit_boosting:
        return False
    return {**BOOSTERS[name], **(params or {})}.get("subsample", 1.0) == 1.0


def _all_numbers(df: DataFrame, feats: Sequence[str]) -> bool:
    return not any(is_vector(df.schema[f].dataType) for f in feats)


def fold_scores(
    train: DataFrame, feats: Sequence[str], y: str, name: str, fold: str = "fold", chronological: bool = False,
    params: dict[str, Any] | None = None,
) -> list[float]:
    """R2 per fold of the fold column.

    Linear and ridge over numbers come from one pass of cross products; other models, and vectors of categories, are
    fitted per fold.
    """
    if name in ("linear", "ridge") and _all_numbers(train, feats):
        alpha = 0.0 if name == "linear" else (params or {}).get("alpha", 1.0)
        return M.cv_scores(M.fold_moments(train, feats, y, fold), lambda m: M.solve(m, alpha), chronological)
    counted = C.cells(train, feats, y, [fold]) if set(feats) <= set(train.columns) - {fold, y} else None
    # Resamples and row weights need the rows themselves; whatever the model, cells are enough to test it.
    source = train if counted is None or name in ROW_MODELS or not _takes_cells(name, params) else counted
    tested = train if counted is None else counted
    held_out = sorted(r[0] for r in tested.select(fold).distinct().collect() if r[0] is not None and r[0] >= 0)
    scores = []
    for held in held_out:
        rest = source.where(F.col(fold) < held) if chronological else source.where(F.col(fold) != held)
        if not rest.limit(1).count():
            continue
        fitted = fit_model(rest, feats, y, name, params)
        if counted is None or fitted.statistics:
            scored = fitted.predict(train.where(F.col(fold) == held), "_guess")
            scores.append(V.regression_metrics(scored, y, "_guess", 15).first()["r2"])
        else:
            scores.append(round(C.r2(fitted.predict(counted.where(F.col(fold) == held), "_guess"), "_guess"), 15))
    return scores


def cv_r2(
    train: DataFrame, feats: Sequence[str], y: str, name: str, fold: str = "fold", chronological: bool = False,
    params: dict[str, Any] | None = None,
) -> float:
    """Mean R2 over the folds."""
    scores = fold_scores(train, feats, y, name, fold, chronological, params)
    return sum(scores) / len(scores) if scores else 0.0


@dataclass(frozen=True)
class Search:
    """Trials of a parameter search and the best of them."""

    trials: tuple[tuple[dict[str, Any], float], ...] = ()

    @property
    def best_params(self) -> dict[str, Any]:
        return max(self.trials, key=lambda t: t[1])[0] if self.trials else {}

    @property
    def best_score(self) -> float | None:
        return max(t[1] for t in self.trials) if self.trials else None


def draws(name: str, trials: int = 25, seed: int = SEED) -> list[dict[str, Any]]:
    """Seeded random parameter sets from a model's ranges, at least five."""
    ranges = MODELS[name].ranges
    rng = random.Random(seed)
    return [{k: draw(rng) for k, draw in ranges.items()} for _ in range(max(5, trials))] if ranges else []


def search(
    train: DataFrame, feats: Sequence[str], y: str, name: str, key: Sequence[str], trials: int = 25, folds: int = 3,
    seed: int = SEED, parallelism: int = 4, fold: str | None = None, chronological: bool = False,
) -> Search:
    """Mean R2 over folds for each drawn parameter set; models without ranges are skipped.

    Folds are drawn by key hash unless ``fold`` names a fold column; with ``chronological`` each of its folds is
    tested on what came before it.
    """
    sets = draws(name, trials, seed)
    if not sets:
        return Search()
    marked = train.withColumn("fold", F.col(fold)) if fold else assign_folds(train, folds, key)
    if name == "ridge" and _all_numbers(marked, feats):
        parts = M.fold_moments(marked, feats, y, "fold")
        scored = []
        for params in sets:
            scores = M.cv_scores(parts, lambda m, a=params["alpha"]: M.solve(m, a), chronological)
            scored.append((params, sum(scores) / len(scores)))
        return Search(tuple(scored))
    slim = marked.select(*dict.fromkeys([*feats, y, "fold"]))
    # Cells of all folds serve every trial; only trials that draw rows read the rows again.
    counted = C.cells(slim, feats, y, ["fold"]) if all(_takes_cells(name, p) for p in sets) and {"fold", y}.isdisjoint(feats) else None
    slim = (slim if counted is None else counted).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(lambda p: cv_r2(slim, feats, y, name, "fold", chronological, p), sets))
    finally:
        slim.unpersist()
    return Search(tuple(zip(sets, scores, strict=True)))


def importance(fitted: Fitted, df: DataFrame, y: str) -> DataFrame:
    """Tree importances, else |r| with the target; strongest first, 4 digits.

    A text that the model takes by its statistic keeps that name. A vector of categories counts as the sum of its entries for trees, and has no r.
    """
    vectors = [f for f in fitted.features if f in df.columns and is_vector(df.schema[f].dataType)]
    if hasattr(fitted.model, "featureImportances"):
        parts = fitted.model.featureImportances.toArray()
        widths = [df.schema[f].metadata["ml_attr"]["num_attrs"] if f in vectors else 1 for f in fitted.features]
        ends = list(itertools.accumulate(widths))
        values = {f: float(parts[e - w : e].sum()) for f, w, e in zip(fitted.features, widths, ends, strict=True)}
    else:
        plain = [f for f in fitted.features if f not in vectors]
        values = {f: abs(r) for f, r in target_correlations(df, plain, y).items()}
    rows = sorted(values.items(), key=lambda x: -x[1])
    made = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return made.withColumn("importance", F.round("importance", 4))


def first_pass(train: DataFrame, test: DataFrame, feats: Sequence[str], y: str, trees: int = 50) -> tuple[DataFrame, DataFrame]:
    """A quick booster: test metrics, and importances that add up to 1."""
    fitted = fit_boosting(train, feats, y, trees=trees)
    return V.regression_metrics(fitted.predict(test), y, "prediction"), importance(fitted, train, y)


#: What a model may fail with on unfit data or settings; anything else is a mistake in the program and ends the run.
FAILURES = (PySparkException, Py4JJavaError, ValueError, ArithmeticError)


@dataclass(frozen=True)
class TrainSettings:
    """What `train_models` does beside fitting."""

    key: tuple[str, ...]
    cv_folds: int = 5
    goal: str = "regression"
    time_based: bool = False
    confidence: float = 0.95
    tune: bool = False
    trials: int = 25
    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    fold: str | None = None


@dataclass(frozen=True)
class Trained:
    """Fitted models and one metrics row per model, failed ones with their error."""

    models: dict[str, Fitted]
    metrics: DataFrame
    best: str | None


_METRICS = {
    "model": "string", "r2": "double", "rmse": "double", "mae": "double", "mape": "double", "accuracy_pct": "double",
    "ci_best": "double", "ci_worst": "double", "ci_average": "double", "ci_lower": "double", "ci_upper": "double",
    "cv_r2": "double", "train_r2": "double", "task_type": "string", "tuned_params": "map<string,string>",
    "tune_score": "double", "error": "string",
}


def _training_r2(model: Fitted, rows: DataFrame, counted: DataFrame | None, y: str) -> float:
    """R2 over the training rows, 4 digits; by their cells where there are some."""
    if counted is None or model.statistics:
        return V.regression_metrics(model.predict(rows), y, "prediction").first()["r2"]
    return round(C.r2(model.predict(counted), "prediction"), 4)


def train_models(
    train: DataFrame, test: DataFrame, feats: Sequence[str], y: str, models: Sequence[str], settings: TrainSettings
) -> Trained:
    """Fit every model, measure each on the test rows, mark the best by R2.

    A model that fails (`FAILURES`) is reported and the others go on; when all fail, the first error is raised.
    """
    spark = train.sparkSession
    chronological = settings.time_based and settings.fold is not None
    marked = train if settings.fold else assign_folds(train, settings.cv_folds, settings.key)
    fold = settings.fold or "fold"
    marked = marked.persist(StorageLevel.MEMORY_AND_DISK)
    held = test.persist(StorageLevel.MEMORY_AND_DISK)
    counted = C.cells(marked, feats, y, [fold]) if {fold, y}.isdisjoint(feats) else None
    fitted: dict[str, Fitted] = {}
    rows, failures = [], []
    try:
        task = V.task_type(held, y, settings.goal, settings.time_based).first()[0]
        for name in models:
            try:
                given = dict(settings.params.get(name, {}))
                tried = Search()
                if settings.tune:
                    own = {"fold": fold, "chronological": True} if chronological else {}
                    tried = search(marked, feats, y, name, settings.key, settings.trials, min(3, settings.cv_folds), **own)
                    given.update(tried.best_params)
                source = counted if counted is not None and _takes_cells(name, given) else marked
                model = fit_model(source, feats, y, name, given)
                scored = model.predict(held).persist(StorageLevel.MEMORY_AND_DISK)
                try:
                    row = {"model": name, "task_type": task, "error": None}
                    row.update(V.regression_metrics(scored, y, "prediction").first().asDict())
                    row.update(V.accuracy_pct(scored, y, "prediction", task).first().asDict())
                    row.update(
                        V.bootstrap(scored, settings.key, y, "prediction", task, settings.confidence).first().asDict()
                    )
                    row["mape"] = V.mape(scored, y, "prediction").first()[0] if settings.time_based else None
                finally:
                    scored.unpersist()
                row["train_r2"] = _training_r2(model, marked, counted, y)
                row["cv_r2"] = round(cv_r2(source, feats, y, name, fold, chronological, given), 4)
                row["tuned_params"] = {k: str(v) for k, v in tried.best_params.items()}
                row["tune_score"] = tried.best_score
                fitted[name] = model
                rows.append(row)
            except FAILURES as error:  # reported in the metrics row
                failures.append(error)
                rows.append({"model": name, "task_type": task, "error": f"{type(error).__name__}: {error}"[:500]})
    finally:
        marked.unpersist()
        held.unpersist()
    if failures and not fitted:
        raise failures[0]
    flat = [tuple(r.get(n) for n in _METRICS) for r in rows]
    schema = ", ".join(f"{n} {t}" for n, t in _METRICS.items())
    made = V.band(spark.createDataFrame(flat, schema))
    done = [r for r in rows if r["model"] in fitted]
    best = max(done, key=lambda r: r["r2"])["model"] if done else None
    return Trained(fitted, made.withColumn("is_best", F.col("model") == F.lit(best)), best)

