"""How well the other columns predict a target: the model-based signal of the target ranking.

Twenty shallow trees are scored in three folds. Trees tell only `SLOTS` values of a text apart, so texts of any
number of values, and targets of any number of classes, are also told apart by statistics per value, always taken from
rows outside the folds they are used for:

* numbers: the mean target of the rows with the same text, one feature of the trees;
* classes: the commonest class of the rows with the same text. It is a feature of the trees, and a prediction of its
  own: where its share of those rows (`TRUST` rows added to them) beats the trees' probability, it is the answer.
  Classes that the trees cannot tell apart are predicted only that way, and then numbers are looked up as well, by
  value and by `BINS` equal-frequency bins.

Each text costs one aggregate by (value, fold) and one join; a row's own fold and the held-out fold choose which sums
count, so one table serves all folds.

Beyond `BINNED_ROWS` rows, from where Spark draws a sample for the borders that trees try, numbers are put into `SLOTS`
equal-frequency bins first. Rows of equal features then are one weighted row, and trees read those cells instead of the
rows, where there are far fewer of them (`cells`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import names
from tabloom.functions.columns import as_number, as_text, col, is_datetime, is_flat, is_numeric
from tabloom.functions.hashing import key_hash
from tabloom.operators import cells as C
from tabloom.operators import evaluate as V

GATE = 0.3
#: Values of a text, and classes of a target, that the trees tell apart; the last slot is for all others.
SLOTS = 128
BINS = 64
TRUST = 2
FOLDS = 3
#: Rows up to which trees read the rows themselves, the most cells, and the least mean number of rows of a cell.
BINNED_ROWS, MOST_CELLS, LEAST_ROWS = 16_384, 400_000, 4
#: Pieces that the rows of all cells are cut into; a forest's resamples draw pieces.
MOST_PIECES = 200_000
#: Rows of a task where trees read rows.
_TASK_ROWS = 50_000
#: The sets of folds that a statistic can be taken from.
_SETS = ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2))


def _model_inputs(df: DataFrame, target: str) -> list[str]:
    flat = [f.name for f in df.schema.fields if is_flat(f.dataType) and not is_datetime(f.dataType)]
    return [c for c in flat if c != target and not names.name_has(c, ("id", "key", "date", "time"))]


def _frequent(df: DataFrame, column: str, slots: int) -> list[str]:
    """The most frequent texts, without those that cannot be in every fold (and could outnumber the rows of two)."""
    top = df.where(col(column).isNotNull()).groupBy(col(column).alias("_text")).agg(F.count(F.lit(1)).alias("_n"))
    top = top.where(F.col("_n") >= FOLDS)
    return [r["_text"] for r in top.orderBy(F.desc("_n"), "_text").limit(slots - 1).collect()]


def _slot_of(text: Column, known: Sequence[str], out: str) -> Column:
    """Place in the short list ``known``, its length for all other texts, as a nominal column."""
    places = F.array_position(F.array(*[F.lit(k) for k in known]).cast("array<string>"), text)
    slot = F.when(places > 0, places - 1).otherwise(len(known)).cast("double")
    return slot.alias(out, metadata={"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(len(known) + 1)]}})


def frequent_slots(df: DataFrame, column: str, out: str, slots: int) -> DataFrame:
    """Number 0.. for each of the most frequent texts, the last slot for nulls and all rarer texts."""
    return df.withColumn(out, _slot_of(col(column), _frequent(df, column, slots), out))


def _used(fold: int, held: int) -> int:
    """Which of `_SETS` gives statistics for rows of ``fold`` while ``held`` is held out."""
    return _SETS.index(tuple(sorted(set(range(FOLDS)) - {fold, held})))


def _by_fold(held: int, value) -> Column:
    """``value(set number)`` chosen by the row's fold."""
    chosen = F.when(F.col("_fold") == 0, value(_used(0, held)))
    for fold in range(1, FOLDS):
        chosen = chosen.when(F.col("_fold") == fold, value(_used(fold, held)))
    return chosen


def _join_back(frame: DataFrame, found: DataFrame, column: str) -> DataFrame:
    return frame.join(found, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def mean_statistics(frame: DataFrame, column: str, name: str) -> DataFrame:
    """``frame`` with sums and counts of ``_y`` per fold over the rows of the same value, as two arrays."""
    sums = [F.sum(F.when(F.col("_fold") == g, F.col("_y"))) for g in range(FOLDS)]
    counts = [F.count_if(F.col("_fold") == g) for g in range(FOLDS)]
    found = frame.groupBy(F.col(column).alias("_value")).agg(
        F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums]).alias(f"s_{name}"), F.array(*counts).alias(f"n_{name}")
    )
    return _join_back(frame, found, column)


def _mean_feature(name: str, held: int, totals: list[tuple[float, int]]) -> Column:
    """Mean of the other rows of the value, one row of the overall mean added."""

    def of(k: int) -> Column:
        overall = sum(totals[g][0] for g in _SETS[k]) / max(1, sum(totals[g][1] for g in _SETS[k]))
        top = sum((F.col(f"s_{name}")[g] for g in _SETS[k]), F.lit(overall))
        return top / sum((F.col(f"n_{name}")[g] for g in _SETS[k]), F.lit(1))

    return _by_fold(held, of)


def class_statistics(frame: DataFrame, column: str, name: str, known: Sequence[str]) -> DataFrame:
    """``frame`` with, per set of folds, the commonest class of the rows of the same value, its rows and all rows.

    A second array has that class's place in ``known``.
    """
    counts = frame.groupBy(F.col(column).alias("_value"), "_y").agg(
        *[F.count_if(F.col("_fold") == g).alias(f"_c{g}") for g in range(FOLDS)]
    )
    made = []
    for folds in _SETS:
        n = sum((F.col(f"_c{g}") for g in folds[1:]), F.col(f"_c{folds[0]}"))
        best = F.max(F.struct(n.alias("n"), F.col("_y").alias("y")))
        made.append(F.struct(best["n"].alias("n"), best["y"].alias("y"), F.sum(n).alias("all")))
    found = counts.groupBy("_value").agg(F.array(*made).alias(f"b_{name}"))
    best = [F.col(f"b_{name}")[k] for k in range(len(_SETS))]
    slots = F.array(*[_slot_of(F.when(b["n"] > 0, b["y"]), known, "_slot") for b in best])
    return _join_back(frame, found.withColumn(f"k_{name}", slots), column)


def _looked_up(name: str) -> Column:
    """(share, rows, class) of the commonest class among the rows of other folds; share 0 where the value is new."""
    found = F.when(F.col("_fold") == 0, F.col(f"b_{name}")[_used(0, 0)])
    for fold in range(1, FOLDS):
        found = found.when(F.col("_fold") == fold, F.col(f"b_{name}")[_used(fold, fold)])
    share = F.coalesce(found["n"] / (found["all"] + TRUST), F.lit(0.0))
    return F.struct(share.alias("share"), F.coalesce(found["n"], F.lit(0)).alias("n"), found["y"].alias("y"))


def _binned(frame: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Equal-frequency bins of the numeric features, by sketched cut points."""
    if not numbers:
        return frame
    steps = [i / BINS for i in range(1, BINS)]
    cuts = frame.agg(*[F.percentile_approx(x, steps, 10_000).alias(x) for x in numbers]).first()
    made = {}
    for x in numbers:
        edges = F.array(*[F.lit(c) for c in sorted(set(cuts[x] or []))]).cast("array<double>")
        made[f"q_{x}"] = F.size(F.filter(edges, lambda e, v=F.col(x): e < v))
    return frame.withColumns(made)


def dependency(
    df: DataFrame, target: str, task: str, cheap: float, key: Sequence[str] = ()
) -> tuple[float, bool, str | None]:
    """(score, skipped, reason): how well the other columns predict this one.

    Mean accuracy of the folds for classes, mean R2 (at least 0) for numbers. Folds go by the hash of ``key``, or of
    the whole row without one. Columns below the gate are skipped.
    """
    if cheap < GATE:
        return 0.0, True, "low_cheap_score"
    inputs = [c for c in _model_inputs(df, target) if c not in key]
    rows = df.where(col(target).isNotNull())
    if not inputs or rows.limit(10).count() < 10:
        return 0.0, False, None
    classes = task == "classification" or not is_numeric(df.schema[target].dataType)
    spread = key_hash(key, "fold") if key else F.xxhash64(*[col(f.name) for f in df.schema.fields if is_flat(f.dataType)])
    values = []
    for i, c in enumerate(inputs):
        text = not is_numeric(df.schema[c].dataType)
        values.append((as_text(rows, c) if text else F.coalesce(as_number(rows, c), F.lit(0.0))).alias(f"{'t' if text else 'x'}{i}"))
    label = as_text(rows, target) if classes else as_number(rows, target)
    frame = rows.select(*values, label.alias("_y"), F.pmod(spread, F.lit(FOLDS)).cast("int").alias("_fold"))
    texts = [c for c in frame.columns if c[0] == "t"]
    numbers = [c for c in frame.columns if c[0] == "x"]
    # Several aggregates read the rows before the trees do; what makes them, joins included, runs once.
    read = frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for t in texts:
            frame = frequent_slots(frame, t, f"i_{t}", SLOTS)
        return (_class_score if classes else _number_score)(frame, texts, numbers), False, None
    finally:
        read.unpersist()


def _mean_over_folds(score) -> float:
    # The folds do not depend on each other, so their jobs share the cluster.
    with ThreadPoolExecutor(FOLDS) as pool:
        scores = [s for s in pool.map(score, range(FOLDS)) if s is not None]
    return round(sum(scores) / len(scores), 4) if scores else 0.0


def _trees(features: str = "_v") -> dict:
    return {"featuresCol": features, "maxDepth": 4, "seed": 42, "maxBins": SLOTS}


def _cells_of(made: DataFrame, used: Sequence[str], y: str, by: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame] | None:
    """``made`` with binned numbers, and its cells; None where trees shall read the rows."""
    if rows <= BINNED_ROWS:
        return None
    nominal = {c: made.schema[c].metadata for c in used if made.schema[c].metadata}
    binned = _tree_bins(made, [c for c in used if c not in nominal])
    # Numbers of slots are plain numbers to the cells.
    plain = binned.withColumns({c: F.col(c).alias(c, metadata={}) for c in nominal})
    found = C.cells(plain.where(F.col(y).isNotNull()), used, y, by, MOST_CELLS, LEAST_ROWS)
    return found and (binned, found.withColumns({c: F.col(c).alias(c, metadata=m) for c, m in nominal.items()}))


def _tree_bins(frame: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Numbers of more than `SLOTS` values as the numbers of their equal-frequency bins, by sketched cut points."""
    if not numbers:
        return frame
    steps = [i / SLOTS for i in range(1, SLOTS)]
    facts = []
    for i, x in enumerate(numbers):
        facts += [F.percentile_approx(x, steps, 10_000).alias(f"c{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(x))).alias(f"u{i}")]
    row = frame.agg(*facts).first()
    many = {x: sorted({c for c in row[f"c{i}"] or [] if math.isfinite(c)}) for i, x in enumerate(numbers) if row[f"u{i}"] > SLOTS}
    split = {x: [-math.inf, *cuts, math.inf] for x, cuts in many.items() if cuts}
    if not split:
        return frame
    outs = [f"_bin_{x}" for x in split]
    made = Bucketizer(inputCols=list(split), outputCols=outs, splitsArray=list(split.values())).transform(frame)
    return made.withColumns({x: F.col(b).alias(x, metadata={}) for x, b in zip(split, outs, strict=True)}).drop(*outs)


def _vectors(frame: DataFrame, used: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(used), outputCol="_v", handleInvalid="keep").transform(frame)


def _dealt(frame: DataFrame, rows: int) -> DataFrame:
    """Rows over enough tasks: few bytes are much work for trees."""
    tasks = min(4 * frame.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / _TASK_ROWS))
    return frame.repartition(tasks) if rows > BINNED_ROWS else frame


def _number_score(frame: DataFrame, texts: list[str], numbers: list[str]) -> float:
    for t in texts:
        frame = mean_statistics(frame, t, t)
    ready = frame.drop(*texts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = {r["_fold"]: (r["s"], r["n"]) for r in ready.groupBy("_fold").agg(F.sum("_y").alias("s"), F.count("_y").alias("n")).collect()}
        totals = [found.get(g, (0.0, 0)) for g in range(FOLDS)]
        rows = sum(n for _, n in totals)

        def score(held: int) -> float | None:
            if not totals[held][1] or rows == totals[held][1]:
                return None
            made = ready.withColumns({f"m_{t}": _mean_feature(t, held, totals) for t in texts})
            used = [*[f"i_{t}" for t in texts], *[f"m_{t}" for t in texts], *numbers]
            slim = made.select(*used, "_y", "_fold")
            # Twenty rounds are a short lineage: no checkpoints in between.
            trees = GBTRegressor(maxIter=20, stepSize=0.2, checkpointInterval=-1, **_trees())
            held_out, others = F.col("_fold") == held, F.col("_fold") != held
            counted = _cells_of(slim, used, "_y", ["_fold"], rows)
            if counted:
                cells = _vectors(counted[1], used)
                model = trees.setLabelCol("_cell_mean").setWeightCol("_cell_rows").fit(cells.where(others))
                return max(0.0, C.r2(model.transform(cells.where(held_out)), "prediction"))
            dealt = _vectors(slim, used).select("_v", "_y", "_fold")
            model = trees.setLabelCol("_y").fit(_dealt(dealt.where(others), rows))
            return max(0.0, V.regression_metrics(model.transform(dealt.where(held_out)), "_y", "prediction", 15).first()["r2"])

        return _mean_over_folds(score)
    finally:
        ready.unpersist()


def _class_score(frame: DataFrame, texts: list[str], numbers: list[str]) -> float:
    if frame.select("_y").distinct().limit(2).count() < 2:
        return 0.0
    known = _frequent(frame, "_y", SLOTS)
    sources = list(texts)
    if frame.where(~F.col("_y").isin(known)).limit(1).count():
        frame = _binned(frame, numbers)
        sources += [*numbers, *[f"q_{x}" for x in numbers]]
    for name in sources:
        frame = class_statistics(frame, name, name, known)
    looked = [_looked_up(name) for name in sources]
    best = F.greatest(*looked) if len(looked) > 1 else looked[0] if looked else None
    share = best["share"] if looked else F.lit(0.0)
    hit = F.coalesce((best["y"] == F.col("_y")).cast("double"), F.lit(0.0)) if looked else F.lit(0.0)
    # From here on classes are places in `known`.
    frame = frame.select(
        "_fold", _slot_of(F.col("_y"), known, "_label"), share.alias("_share"), hit.alias("_hit"), *numbers,
        *[f"i_{t}" for t in texts], *[f"k_{t}" for t in texts],
    )
    ready = frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folds = {r["_fold"]: r["count"] for r in ready.groupBy("_fold").count().collect()}

        def score(held: int) -> float | None:
            if held not in folds or len(folds) < 2:
                return None
            scored = ready.where(F.col("_fold") == held)
            answer, chance = F.lit(None).cast("double"), F.lit(0.0)
            if len(known) > 1:
                scored = _forest_answers(ready, held, texts, numbers, known, sum(folds.values()))
                answer, chance = F.col("_answer"), F.col("_chance")
            right = F.when(F.col("_share") > chance, F.col("_hit")).otherwise((answer == F.col("_label")).cast("double"))
            return scored.agg(F.avg(F.coalesce(right, F.lit(0.0)))).first()[0]

        return _mean_over_folds(score)
    finally:
        ready.unpersist()


def _forest_answers(
    ready: DataFrame, held: int, texts: list[str], numbers: list[str], known: list[str], rows: int
) -> DataFrame:
    """The held-out rows, the place of the class that a forest of the other rows gives them, and its probability."""
    slots = [str(i) for i in range(len(known) + 1)]
    commonest = {
        f"m_{t}": _by_fold(held, lambda k, t=t: F.col(f"k_{t}")[k]).alias(f"m_{t}", metadata={"ml_attr": {"type": "nominal", "vals": slots}})
        for t in texts
    }
    used = [*[f"i_{t}" for t in texts], *commonest, *numbers]
    made = ready.withColumns(commonest).drop(*[f"k_{t}" for t in texts])
    trees = RandomForestClassifier(labelCol="_label", numTrees=20, **_trees())
    held_out, others = F.col("_fold") == held, F.col("_fold") != held
    counted = _cells_of(made, used, "_label", ["_fold", "_label"], rows)
    # The slot that rare classes share is no class and is never the answer.
    chances = F.slice(vector_to_array("probability"), 1, len(known))
    answers = {"_chance": F.array_max(chances), "_answer": F.array_position(chances, F.array_max(chances)).cast("double") - 1}
    if not counted:
        dealt = _vectors(made, used)
        model = trees.fit(_dealt(dealt.where(others).select("_v", "_label"), rows))
        return model.transform(dealt.where(held_out)).withColumns(answers)
    binned, cells = counted
    weight = F.col("_cell_rows")
    pieces = F.ceil(weight / max(1.0, rows / MOST_PIECES))
    cut = _vectors(cells.where(others), used).select("_v", "_label", (weight / pieces).alias("_n"), F.explode(F.sequence(F.lit(1), pieces)))
    model = trees.setWeightCol("_n").fit(_dealt(cut.select("_v", "_label", "_n"), min(rows, MOST_PIECES)))
    # A bounded table: one row per cell of the held-out rows.
    told = model.transform(_vectors(cells.where(held_out).select(*used).distinct(), used)).withColumns(answers).select(*used, *answers)
    return binned.where(held_out).join(F.broadcast(told), used)
