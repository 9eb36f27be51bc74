"""Sums of products of columns, and least squares from them.

Linear and ridge regression need only sums of products, and so do their errors on held-out rows. One pass therefore
answers a whole search: every fold, every penalty, any number of features. Tasks multiply blocks of rows as matrices
and send one number per pair of columns (and fold), which Spark adds up; the driver solves k x k systems, k being the
number of features.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number

#: Rows that are multiplied at once.
BLOCK_ROWS = 16_384


def cross_products(frame: DataFrame, left: Sequence[Column], right: Sequence[Column], by: Column | None = None) -> dict:
    """Group -> matrix of sums of left[i] * right[j] over its rows, all entries being numbers (no nulls).

    Without ``by`` there is one group, 0. One pass, whatever the number of columns; rows without a group are left out.
    """
    m, k = len(left), len(right)
    group = F.lit(0) if by is None else by
    numbers = [F.array(*[c.cast("double") for c in side]) for side in (left, right)]
    rows = frame.select(group.cast("int").alias("g"), numbers[0].alias("a"), numbers[1].alias("b")).where(F.col("g").isNotNull())

    def multiply(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                groups = part.column(0).to_numpy()
                a = part.column(1).flatten().to_numpy().reshape(-1, m)
                b = part.column(2).flatten().to_numpy().reshape(-1, k)
                for g in np.unique(groups).tolist():
                    mine = groups == g
                    product = a[mine].T @ b[mine]
                    sums[g] = sums[g] + product if g in sums else product
        for g, total in sums.items():
            columns = [pa.array(np.full(m * k, g, np.int32)), pa.array(np.arange(m * k, dtype=np.int32)), pa.array(total.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, ["g", "place", "v"])

    added = rows.mapInArrow(multiply, "g int, place int, v double").groupBy("g", "place").agg(F.sum("v").alias("v"))
    table = added.toArrow()
    groups, places, values = (table[c].to_numpy() for c in ("g", "place", "v"))
    found = {}
    for g in np.unique(groups).tolist():
        mine = groups == g
        matrix = np.zeros(m * k)
        matrix[places[mine]] = values[mine]
        found[g] = matrix.reshape(m, k)
    return found


@dataclass
class Moments:
    """Row count, sums and cross products of (features, target) around common centres."""

    n: float
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.sums + other.sums, self.products + other.products)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and co-moments around the own means."""
        means = self.sums / self.n
        return means, self.products - self.n * np.outer(means, means)


def fold_moments(df: DataFrame, feats: Sequence[str], y: str, fold: str) -> dict[int, Moments]:
    """Moments per value of the fold column, gaps as 0; one pass for the centres and one for the products."""
    names = [*feats, y]
    xs = [f"x{i}" for i in range(len(names))]
    frame = df.select(
        *[F.coalesce(as_number(df, c), F.lit(0.0)).alias(x) for c, x in zip(names, xs, strict=True)],
        F.col(fold).alias("fold"),
    )
    means = frame.agg(*[F.avg(x).alias(x) for x in xs]).first()
    centred = [F.lit(1.0), *[F.col(x) - F.lit(means[x] or 0.0) for x in xs]]
    found = cross_products(frame, centred, centred, F.col("fold"))
    return {fold: Moments(float(p[0, 0]), p[0, 1:], p[1:, 1:]) for fold, p in found.items()}


def solve(train: Moments, alpha: float = 0.0, standard: bool = False) -> tuple[np.ndarray, float]:
    """Coefficients and intercept (around the common centres) of ridge with penalty alpha.

    ``standard`` scales the features by their population deviation first.
    """
    means, co = train.centred()
    xx, xy = co[:-1, :-1], co[:-1, -1]
    scale = np.sqrt(np.diag(xx) / train.n) if standard else np.ones(len(xx))
    scale = np.where(scale > 0, scale, 1.0)
    xx, xy = xx / np.outer(scale, scale), xy / scale
    system = xx + alpha * np.eye(len(xx))
    beta = np.linalg.lstsq(system, xy, rcond=None)[0] / scale
    return beta, float(means[-1] - means[:-1] @ beta)


def r2_on(test: Moments, beta: np.ndarray, intercept: float) -> float:
    """R2 of a linear predictor on held-out rows, from their moments."""
    sums, p = test.sums, test.products
    b = np.append(-beta, 1.0)
    wrong = b @ p @ b - 2 * intercept * (b @ sums) + test.n * intercept**2
    total = p[-1, -1] - sums[-1] ** 2 / test.n
    if test.n < 2:
        return 0.0
    if total <= 0:
        return 1.0 if wrong <= 0 else 0.0
    return float(1 - wrong / total)


def cv_scores(
    moments: dict[int, Moments], fit: Callable[[Moments], tuple[np.ndarray, float]], chronological: bool = False
) -> list[float]:
    """R2 per fold. Chronological folds train on the earlier ones, fold -1 included."""
    scores = []
    for held in sorted(k for k in moments if k >= 0):
        others = [m for k, m in moments.items() if (k < held if chronological else k != held)]
        if not others:
            continue
        train = sum(others[1:], others[0])
        scores.append(r2_on(moments[held], *fit(train)))
    return scores
