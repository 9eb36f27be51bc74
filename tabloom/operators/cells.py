"""Training rows of equal features as one weighted row.

A tree that splits by squared error reads nothing of its rows but, for each value of the features, their number and their
mean: the spread within equal features is the same on both sides of every split. Rows of equal features therefore become
one row, a cell, and a fit reads cells instead of rows, with the same splits and leaves. Where features hardly repeat
there is nothing to gain and no table of cells is made; rows are trained on as they are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import as_number, col
from tabloom.functions.vectors import is_vector
from tabloom.operators.encode import assemble
from tabloom.session import shared_dir

#: The most cells of a table, and the least mean number of rows of a cell, that make cells worth while.
MOST_CELLS, LEAST_ROWS = 100_000, 10
#: Cells of one partition.
_TOGETHER = 20_000
#: Rows that are drawn for all trees at once.
_DRAWN_ROWS = 2048
_PREFIX = "_cell_"


def is_cells(df: DataFrame) -> bool:
    return f"{_PREFIX}rows" in df.columns


def numbers(df: DataFrame, feats: Sequence[str]) -> list[Column]:
    """The features as the models read them, gaps as 0."""
    return [F.coalesce(as_number(df, f), F.lit(0.0)).alias(f) for f in feats]


def place(feats: Sequence[str]) -> Column:
    """A 64-bit number of the features' values; 0.0 and -0.0, which are equal, share one."""
    return F.xxhash64(*[col(f) + F.lit(0.0) for f in feats])


def cells(
    df: DataFrame, feats: Sequence[str], y: str, by: Sequence[str] = (), most: int = MOST_CELLS, least: int = LEAST_ROWS
) -> DataFrame | None:
    """One stored row per value of the features (and ``by``), or None where that would not be far fewer rows.

    Beside the features there are the rows and their mean target, gaps as 0, and of the targets that are no gaps the
    number, mean, sum of squares around it, lowest and highest. A sketch tells beforehand how many cells there are.
    """
    if is_cells(df):
        return df
    fields = [df.schema[f] for f in feats]
    # Texts may stand for statistics of their own, and categories have a number of values that cells may not reach.
    if not fields or any(isinstance(f.dataType, T.StringType) or is_vector(f.dataType) or "ml_attr" in f.metadata for f in fields):
        return None
    known = as_number(df, y)
    slim = df.select(*numbers(df, feats), *[col(b) for b in by], known.alias("_known"))
    keys = [*feats, *by]
    size = slim.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*[col(k) for k in keys])).alias("u")).first()
    if size["u"] > most or size["u"] * least > size["n"]:
        return None
    shared_dir(df.sparkSession)
    made = slim.groupBy(*[col(k) for k in keys]).agg(
        F.count(F.lit(1)).cast("double").alias(f"{_PREFIX}rows"), F.avg(F.coalesce("_known", F.lit(0.0))).alias(f"{_PREFIX}mean"),
        F.count("_known").alias(f"{_PREFIX}known"), F.avg("_known").alias(f"{_PREFIX}known_mean"),
        F.regr_syy("_known", "_known").alias(f"{_PREFIX}spread"),
        F.min("_known").alias(f"{_PREFIX}low"), F.max("_known").alias(f"{_PREFIX}high"),
    )
    return made.coalesce(max(1, math.ceil(size["u"] / _TOGETHER))).checkpoint()


def cut_points(df: DataFrame, feats: Sequence[str], most: int) -> dict[str, list[float]]:
    """Where Spark's trees may split numbers: between any two values, or at ``most`` - 1 quantiles if there are more values.

    Spark takes the quantiles from about 10,000 rows; here they are sketched over all.
    """
    if not feats:
        return {}
    rows = df.select(*numbers(df, feats))
    facts = []
    for i, f in enumerate(feats):
        facts += [
            F.percentile_approx(col(f), [j / most for j in range(1, most)], 10_000).alias(f"c{i}"),
            F.approx_count_distinct(F.xxhash64(col(f) + F.lit(0.0))).alias(f"u{i}"),
        ]
    row = rows.agg(*facts).first()
    found = {f: sorted({c for c in row[f"c{i}"] or [] if math.isfinite(c)}) for i, f in enumerate(feats)}
    # The sketch may miss rare values where there are few.
    for f in (f for i, f in enumerate(feats) if row[f"u{i}"] <= 2 * most):
        values = sorted(v[0] for v in rows.select(col(f) + F.lit(0.0)).distinct().collect())
        if len(values) <= most:
            found[f] = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    return found


def binned(df: DataFrame, feats: Sequence[str], cuts: dict[str, list[float]]) -> tuple[DataFrame, list[str]]:
    """``df`` with the number of cut points below each value in columns of their own, and the features' names then."""
    made = {}
    for i, f in enumerate(feats):
        if f in cuts:
            value = F.coalesce(as_number(df, f), F.lit(0.0))
            made[f"_bin{i}"] = sum(((value > c).cast("double") for c in cuts[f]), F.lit(0.0))
    return df.withColumns(made) if made else df, [f"_bin{i}" if f in cuts else f for i, f in enumerate(feats)]


def weighted(made: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Feature vector, label and weight of cells."""
    return assemble(made, feats, "_v").select("_v", F.col(f"{_PREFIX}mean").alias("_y"), F.col(f"{_PREFIX}rows").alias("_n"))


def leaves(made: DataFrame, least: int, depth: int, rows: str = f"{_PREFIX}rows") -> dict:
    """Settings of a tree whose leaves hold ``least`` rows at least: Spark counts cells, so their weights are bounded."""
    if least <= 1:
        return {"maxDepth": depth}
    total = made.agg(F.sum(rows)).first()[0] or 0.0
    return {"maxDepth": depth, "minWeightFractionPerNode": (least - 0.5) / total} if total >= 2 * least else {"maxDepth": 0}


def r2(scored: DataFrame, pred: str) -> float:
    """R2 of cells with a prediction each, as of their rows with a target."""
    known, guess, low, high = F.col(f"{_PREFIX}known"), F.col(pred), F.col(f"{_PREFIX}low"), F.col(f"{_PREFIX}high")
    # The mean of equal targets may be off by a rounding.
    mean = F.when(low == high, low).otherwise(F.col(f"{_PREFIX}known_mean"))
    some = scored.where(known > 0)
    facts = some.agg(
        F.sum(known).alias("n"), (F.sum(known * mean) / F.sum(known)).alias("mean"),
        (F.min(low) == F.max(high)).alias("constant"),
    ).first()
    if not facts["n"] or facts["n"] < 2:
        return 0.0
    around = [F.sum(F.col(f"{_PREFIX}spread") + known * F.pow(mean - c, F.lit(2))) for c in (guess, F.lit(facts["mean"]))]
    wrong, total = some.agg(*around).first()
    if facts["constant"] or total <= 0:
        return 1.0 if wrong == 0 else 0.0
    found = 1 - wrong / total
    return found if math.isfinite(found) else 0.0


def drawn_cells(df: DataFrame, feats: Sequence[str], y: str, made: DataFrame, trees: int, seed: int) -> DataFrame:
    """Cells of ``trees`` resamples: (features, tree, _n, _y), each row taken a Poisson(1) number of times.

    One pass: a task draws for all trees while it reads and sends one row per cell and tree. As in Spark's forests the
    draws go by partition and place of the rows.
    """
    rows = df.select(*numbers(df, feats), F.coalesce(as_number(df, y), F.lit(0.0)).alias("_y")).select(place(feats).alias("_at"), "_y")

    def draw(batches):
        rng = np.random.Generator(np.random.SFC64([seed, TaskContext.get().partitionId()]))
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            all_at, all_y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for start in range(0, len(all_at), _DRAWN_ROWS):
                at, label = all_at[start : start + _DRAWN_ROWS], all_y[start : start + _DRAWN_ROWS]
                times = rng.poisson(1.0, (len(at), trees)).astype(np.float64)
                values, which = np.unique(at, return_inverse=True)
                for i, value in enumerate(values.tolist()):
                    mine = which == i
                    part = np.stack((np.ones(int(mine.sum())), label[mine])) @ times[mine]
                    sums[value] = sums[value] + part if value in sums else part
        numbered = pa.array(np.arange(trees, dtype=np.int32))
        for value, (n, s) in sums.items():
            columns = [pa.array(np.full(trees, value, np.int64)), numbered, pa.array(n), pa.array(s)]
            yield pa.RecordBatch.from_arrays(columns, ["_at", "tree", "n", "s"])

    added = rows.mapInArrow(draw, "_at bigint, tree int, n double, s double").groupBy("_at", "tree")
    added = added.agg(F.sum("n").alias("_n"), F.sum("s").alias("_s")).where(F.col("_n") > 0)
    known = made.select(*feats).distinct().withColumn("_at", place(feats))
    return added.join(F.broadcast(known), "_at").select(*feats, "tree", "_n", (F.col("_s") / F.col("_n")).alias("_y"))
