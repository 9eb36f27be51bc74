"""Boosting beyond gradient-boosted trees: AdaBoost.R2, and ordered target statistics for categories."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number, as_text, col
from tabloom.functions.hashing import key_hash
from tabloom.operators.cells import leaves
from tabloom.operators.ordered import BLOCK_ROWS, WINDOW_LIMIT
from tabloom.session import shared_dir

#: Rounds after which the weighted table is written, so that a lost executor does not replay all of them.
CHECKPOINT_ROUNDS = 10


class WeightedMedian:
    """Trees with weights; a row's prediction is the weighted median of theirs."""

    def __init__(self, trees: Sequence, weights: Sequence[float]):
        self.trees, self.weights, self.out = list(trees), list(weights), "prediction"

    def setPredictionCol(self, name: str) -> WeightedMedian:  # noqa: N802 - as Spark's models have it
        self.out = name
        return self

    @property
    def featureImportances(self):  # noqa: N802
        total = sum(w * t.featureImportances.toArray() for t, w in zip(self.trees, self.weights, strict=True))
        size = float(np.sum(total))
        return Vectors.dense(total / size if size else total)

    def transform(self, df: DataFrame) -> DataFrame:
        frame = df
        for i, tree in enumerate(self.trees):
            frame = tree.setPredictionCol(f"_t{i}").transform(frame)
        votes = [F.struct(F.col(f"_t{i}").alias("p"), F.lit(float(w)).alias("w")) for i, w in enumerate(self.weights)]
        half = F.lit(sum(self.weights) / 2)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))

        def step(so_far: Column, vote: Column) -> Column:
            reached = so_far["sum"] + vote["w"]
            # The first prediction that brings half of the weights together.
            found = F.when(so_far["p"].isNull() & (reached >= half - 1e-12), vote["p"]).otherwise(so_far["p"])
            return F.struct(reached.alias("sum"), found.alias("p"))

        middle = F.aggregate(F.array_sort(F.array(*votes)), start, step)["p"]
        return frame.withColumn(self.out, middle).drop(*[f"_t{i}" for i in range(len(self.trees))])


class MeanOfTrees:
    """A forest of trees that were fitted one by one; a row's prediction is the mean of theirs."""

    def __init__(self, trees: Sequence):
        self.trees, self.out = list(trees), "prediction"

    def setPredictionCol(self, name: str) -> MeanOfTrees:  # noqa: N802 - as Spark's models have it
        self.out = name
        return self

    @property
    def featureImportances(self):  # noqa: N802
        total = sum(t.featureImportances.toArray() for t in self.trees)
        size = float(np.sum(total))
        return Vectors.dense(total / size if size else total)

    def transform(self, df: DataFrame) -> DataFrame:
        frame = df
        for i, tree in enumerate(self.trees):
            frame = tree.setPredictionCol(f"_t{i}").transform(frame)
        votes = F.array(*[F.col(f"_t{i}") for i in range(len(self.trees))])
        mean = F.aggregate(votes, F.lit(0.0), lambda a, v: a + v) / len(self.trees)
        return frame.withColumn(self.out, mean).drop(*[f"_t{i}" for i in range(len(self.trees))])


def fit_trees(
    drawn: DataFrame, trees: int, least: int, max_depth: int, max_features: str, seed: int = 42, parallelism: int = 8
) -> MeanOfTrees:
    """A forest from the weighted cells (``_v``, ``_y``, ``_n``) of every ``tree``'s resample."""
    kept = drawn.coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def fit(number: int):
            mine = kept.where(F.col("tree") == number)
            estimator = RandomForestRegressor(
                featuresCol="_v", labelCol="_y", weightCol="_n", numTrees=1, bootstrap=False, featureSubsetStrategy=max_features,
                seed=seed + number, **leaves(mine, least, max_depth, "_n"),
            )
            return estimator.fit(mine).trees[0]

        kept.count()
        with ThreadPoolExecutor(parallelism) as pool:
            return MeanOfTrees(list(pool.map(fit, range(trees))))
    finally:
        kept.unpersist()


def fit_adaboost_cells(
    rows: DataFrame, known: DataFrame, trees: int = 100, learning_rate: float = 0.1, max_depth: int = 4, seed: int = 42
) -> WeightedMedian:
    """`fit_adaboost` where features repeat: rows (``_at``, ``_y``) of cells ``known`` (``_at``, ``_v``).

    Weights stay with the rows. A round adds them up per cell, fits its tree to the cells and reads the rows once more
    for the errors; the predictions of a tree are one number per cell.
    """
    shared_dir(rows.sparkSession)
    known = known.persist(StorageLevel.MEMORY_AND_DISK)
    state = rows.withColumn("_w", F.lit(1.0)).persist(StorageLevel.MEMORY_AND_DISK)
    before, made, weights = None, [], []
    try:
        for number in range(trees):
            sums = state.groupBy("_at").agg(F.sum("_w").alias("_n"), F.sum(F.col("_w") * F.col("_y")).alias("_s"))
            counted = sums.join(F.broadcast(known), "_at").select("_at", "_v", (F.col("_s") / F.col("_n")).alias("_y"), "_n")
            counted = counted.where(F.col("_n") > 0).coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)
            tree = DecisionTreeRegressor(
                featuresCol="_v", labelCol="_y", weightCol="_n", predictionCol="_p", maxDepth=max_depth, seed=seed + number
            ).fit(counted)
            guesses = tree.transform(known).select("_at", "_p")
            scored = state.join(F.broadcast(guesses), "_at").withColumn("_e", F.abs(F.col("_y") - F.col("_p")))
            row = scored.agg(F.max("_e").alias("most"), F.sum(F.col("_w") * F.col("_e")).alias("wrong"), F.sum("_w").alias("all")).first()
            counted.unpersist()
            if before is not None:
                before.unpersist()
            if not row["most"]:
                made.append(tree)
                weights.append(1.0)
                break
            loss = row["wrong"] / (row["most"] * row["all"])
            if loss >= 0.5:
                if not made:
                    made.append(tree)
                    weights.append(1.0)
                break
            beta = loss / (1 - loss)
            made.append(tree)
            weights.append(learning_rate * math.log(1 / beta))
            if number + 1 == trees:
                break
            right = 1 - F.col("_e") / F.lit(row["most"])
            fresh = F.col("_w") / F.lit(row["all"] / 1.0) * F.pow(F.lit(beta), right * learning_rate)
            following = scored.select("_at", "_y", fresh.alias("_w"))
            if (number + 1) % CHECKPOINT_ROUNDS == 0:
                following = following.checkpoint()
            # The next sums store the new weights; until then they are made from the old ones.
            before, state = state, following.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        state.unpersist()
        if before is not None:
            before.unpersist()
        known.unpersist()
    return WeightedMedian(made, weights)


def fit_adaboost(
    frame: DataFrame, trees: int = 100, learning_rate: float = 0.1, max_depth: int = 4, seed: int = 42
) -> WeightedMedian:
    """AdaBoost.R2 with linear loss over ``_v`` and ``_y``.

    Rows carry a weight column instead of being drawn anew: a round fits a tree to the weighted rows, and one
    aggregate gives its largest and its weighted error. Rows it gets right lose weight. Rounds end early with a tree
    that is perfect or no better than chance.
    """
    shared_dir(frame.sparkSession)
    state = frame.select("_v", "_y", F.lit(1.0).alias("_w")).persist(StorageLevel.MEMORY_AND_DISK)
    made, weights = [], []
    try:
        for number in range(trees):
            tree = DecisionTreeRegressor(
                featuresCol="_v", labelCol="_y", weightCol="_w", predictionCol="_p", maxDepth=max_depth, seed=seed + number
            ).fit(state)
            scored = tree.transform(state).withColumn("_e", F.abs(F.col("_y") - F.col("_p")))
            row = scored.agg(F.max("_e").alias("most"), F.sum(F.col("_w") * F.col("_e")).alias("wrong"), F.sum("_w").alias("all")).first()
            if not row["most"]:
                made.append(tree)
                weights.append(1.0)
                break
            loss = row["wrong"] / (row["most"] * row["all"])
            if loss >= 0.5:
                if not made:
                    made.append(tree)
                    weights.append(1.0)
                break
            beta = loss / (1 - loss)
            made.append(tree)
            weights.append(learning_rate * math.log(1 / beta))
            if number + 1 == trees:
                break
            right = 1 - F.col("_e") / F.lit(row["most"])
            fresh = F.col("_w") / F.lit(row["all"] / 1.0) * F.pow(F.lit(beta), right * learning_rate)
            following = scored.select("_v", "_y", fresh.alias("_w"))
            if (number + 1) % CHECKPOINT_ROUNDS == 0:
                following = following.checkpoint()
            following = following.persist(StorageLevel.MEMORY_AND_DISK)
            following.count()
            state.unpersist()
            state = following
    finally:
        state.unpersist()
    return WeightedMedian(made, weights)


#: The most bytes of a table of texts that is sent to every task.
SENT_BYTES = 8_000_000
#: Rows that one task puts in order, on average.
SORTED_ROWS = 1_000_000


@dataclass(frozen=True)
class TargetStatistics:
    """Sums of the target per text of a column (a table, one row per text), for rows that were not trained on."""

    column: str
    table: DataFrame
    prior: float
    #: Whether the table is small enough to be sent to every task.
    small: bool = False

    @property
    def feature(self) -> str:
        return f"{self.column}_stat"

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the statistic of its texts; unseen texts get the overall mean."""
        if self.column not in df.columns:
            return df.withColumn(self.feature, F.lit(self.prior))
        known = self.table.withColumnsRenamed({"value": "_value", "s": "_s", "n": "_n"})
        known = F.broadcast(known) if self.small else known
        joined = df.join(known, as_text(df, self.column).eqNullSafe(F.col("_value")), "left")
        return joined.withColumn(self.feature, smoothed(F.col("_s"), F.col("_n"), self.prior)).drop("_value", "_s", "_n")


def smoothed(total: Column, n: Column, prior: float) -> Column:
    """Mean of n rows and one more that has the overall mean."""
    return (F.coalesce(total, F.lit(0.0)) + F.lit(prior)) / (F.coalesce(n, F.lit(0)) + 1)


def ordered_statistics(
    df: DataFrame, column: str, y: str, key: Sequence[str], limit: int = WINDOW_LIMIT, block_rows: int = BLOCK_ROWS
) -> tuple[DataFrame, TargetStatistics]:
    """``df`` with the mean target of the earlier rows of the same text, in the order of a hash of the key.

    A row never sees its own target, nor do rows that come before it; the first row of a text gets the overall mean.
    A text of more than ``limit`` rows is cut into blocks of about ``block_rows``: hashes are even, so equal ranges of them
    are blocks, and what the blocks before hold is added to the running sums. ``key`` must name every row. Nulls are a
    text of their own; a missing target counts as 0.
    """
    shared_dir(df.sparkSession)
    frame = df.withColumns({"_text": as_text(df, column), "_at": key_hash(key, "order"), "_target": F.coalesce(as_number(df, y), F.lit(0.0))})
    table = frame.groupBy(F.col("_text").alias("value")).agg(F.sum("_target").alias("s"), F.count(F.lit(1)).alias("n")).checkpoint()
    size = F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 40)
    facts = table.agg((F.sum("s") / F.sum("n")).alias("prior"), F.sum("n").alias("rows"), F.max("n").alias("most"), size.alias("bytes")).first()
    made = TargetStatistics(column, table, facts["prior"] or 0.0, (facts["bytes"] or 0) <= SENT_BYTES)
    series, before = ["_text"], {"_sum0": F.lit(0.0), "_count0": F.lit(0)}
    if (facts["most"] or 0) > limit:
        # Rows / limit texts at most, and a few times rows / block_rows blocks.
        large = table.where(F.col("n") > limit).select(F.col("value").alias("_large"), F.ceil(F.col("n") / block_rows).alias("_blocks"))
        frame = frame.join(F.broadcast(large), F.col("_text").eqNullSafe(F.col("_large")), "left")
        frame = frame.withColumn("_block", F.shiftright(F.col("_at") * F.coalesce("_blocks", F.lit(1)), 32)).drop("_large")
        along = Window.partitionBy("_text").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        sums = frame.where(F.col("_blocks").isNotNull()).groupBy("_text", "_block").agg(F.sum("_target").alias("s"), F.count(F.lit(1)).alias("n"))
        carried = sums.select(
            F.col("_text").alias("_text0"), F.col("_block").alias("_block0"), F.sum("s").over(along).alias("_sum0"), F.sum("n").over(along).alias("_count0")
        )
        series, before = ["_block", "_text"], {}
    tasks = math.ceil((facts["rows"] or 0) / SORTED_ROWS)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        frame = frame.repartition(tasks, *series)
    earlier = Window.partitionBy(*series).orderBy("_at", *[col(k) for k in key])
    ranked = frame.withColumns(
        {"_sum": F.sum("_target").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), "_count": F.row_number().over(earlier) - 1, **before}
    )
    if not before:
        same = F.col("_text").eqNullSafe(F.col("_text0")) & (F.col("_block") == F.col("_block0"))
        ranked = ranked.join(F.broadcast(carried), same, "left")
    total = F.coalesce("_sum", F.lit(0.0)) + F.coalesce("_sum0", F.lit(0.0))
    stat = smoothed(total, F.col("_count") + F.coalesce("_count0", F.lit(0)), made.prior)
    helpers = ["_text", "_at", "_target", "_sum", "_count", "_sum0", "_count0", "_block", "_blocks", "_text0", "_block0"]
    return ranked.withColumn(made.feature, stat).drop(*helpers), made
