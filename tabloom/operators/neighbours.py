"""Mutual information of two numeric columns from nearest neighbours (Kraskov, Stoegbauer and Grassberger).

MI = psi(n) + psi(k) - mean(psi(cx)) - mean(psi(cy)), where r is a row's distance (the larger of both coordinate
differences) to its k-th neighbour and cx, cy count the rows, itself included, that are closer than r in one coordinate.

Neighbours come from a grid: strips of equally many rows by x, and each strip cut into cells of equally many rows by y,
so crowded places get small cells. A row is first compared with its own cell, which bounds r; then it visits only the
cells that its square of that size reaches into. A cell's rows stay in memory while its visitors stream by. The counts
per coordinate are differences of ranks: rows and the ends of all intervals are put in one order and counted through it,
in blocks. No pair of rows is formed outside of a cell and its visitors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import as_number
from tabloom.functions.hashing import key_hash
from tabloom.operators.ordered import WINDOW_LIMIT, Ordered
from tabloom.session import scratch_path

#: Rows of a cell, unless the table is so large that this many strips of this many cells hold more.
CELL_ROWS, MOST_STRIPS = 512, 256
_BLOCK = 256
#: Ties are broken by a share of this size, drawn from the row's key.
NOISE = 1e-10


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scaled(df: DataFrame, a: str, b: str, key: Sequence[str]) -> DataFrame:
    """(x, y) of the rows where both are present: in units of their deviation, ties broken by the key."""
    frame = df.select(as_number(df, a).alias("x"), as_number(df, b).alias("y"), *[(key_hash(key, s) / 2**32 - 0.5).alias(s) for s in ("u", "v")])
    frame = frame.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    facts = frame.agg(
        *[F.stddev_pop(c).alias(f"s{c}") for c in "xy"], *[F.avg(F.abs(c)).alias(f"m{c}") for c in "xy"], F.count(F.lit(1)).alias("n")
    ).first()
    made = []
    for c, noise in (("x", "u"), ("y", "v")):
        unit = facts[f"s{c}"] or 1.0
        usual = max(1.0, (facts[f"m{c}"] or 0.0) / unit)
        made.append((F.col(c) / F.lit(unit) + F.lit(NOISE * usual) * F.col(noise)).alias(c))
    return frame.select(*made)


def _grid(rows: DataFrame, n: int, cell_rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Borders of the strips by x and, per strip, of its cells by y; at most MOST_STRIPS squared numbers."""
    strips = min(MOST_STRIPS, max(1, math.ceil(math.sqrt(n / cell_rows))))
    if strips == 1:
        return np.zeros(0), [np.zeros(0)]
    steps = [i / strips for i in range(1, strips)]
    along = np.unique(rows.agg(F.percentile_approx("x", steps, 10_000).alias("c")).first()["c"])
    strip = F.size(F.filter(F.array(*[F.lit(float(c)) for c in along]), lambda c: c <= F.col("x")))
    found = rows.groupBy(strip.alias("s")).agg(F.percentile_approx("y", steps, 10_000).alias("c")).collect()
    across = {r["s"]: np.unique(r["c"]) for r in found}
    return along, [across.get(i, np.zeros(0)) for i in range(len(along) + 1)]


def _closest(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, k: int) -> np.ndarray:
    """The k + 1 smallest distances of each row (x, y) to the rows (ax, ay), ascending, padded with infinity."""
    found = np.full((len(x), k + 1), np.inf)
    for start in range(0, len(x), _BLOCK):
        part = slice(start, start + _BLOCK)
        d = np.maximum(np.abs(x[part, None] - ax), np.abs(y[part, None] - ay))
        if d.shape[1] > k + 1:
            d = np.partition(d, k, axis=1)[:, : k + 1]
        d.sort(axis=1)
        found[part, : d.shape[1]] = d
    return found


def neighbour_distances(df: DataFrame, k: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(row, x, y, r): the distance of each row (row, x, y) to its k-th neighbour; infinity with fewer rows.

    ``df`` is a stored table whose ``row`` names each row.
    """
    n = df.count()
    along, across = _grid(df, n, cell_rows)
    base = np.concatenate([[0], np.cumsum([len(c) + 1 for c in across])])

    def cells(batches):
        for batch in batches:
            x, y = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            strip = np.searchsorted(along, x, "right")
            cell = np.empty(len(x), np.int32)
            for s in np.unique(strip):
                mine = strip == s
                cell[mine] = base[s] + np.searchsorted(across[s], y[mine], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["row", "x", "y", "cell"])

    placed = df.select("row", "x", "y").mapInArrow(cells, "row bigint, x double, y double, cell int")

    def reached(x: float, y: float, r: float, own: int) -> list[int]:
        """The other cells that the square around (x, y) reaches into."""
        s0, s1 = np.searchsorted(along, x - r, "left"), np.searchsorted(along, x + r, "right")
        found = []
        for s in range(int(s0), int(s1) + 1):
            c0, c1 = np.searchsorted(across[s], y - r, "left"), np.searchsorted(across[s], y + r, "right")
            found.extend(range(int(base[s] + c0), int(base[s] + c1) + 1))
        return [c for c in found if c != own]

    def runs(batches):
        """(cell, kind, columns) of consecutive rows of one cell and kind."""
        for batch in batches:
            cell, kind = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1 if len(cell) else []
            for a, b in zip([0, *edges], [*edges, len(cell)], strict=True):
                if b > a:
                    yield int(cell[a]), int(kind[a]), [batch.column(i).to_numpy()[a:b] for i in (0, 1, 2)]

    def own(batches):
        held, current = [], None

        def answer():
            row, x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            for start in range(0, len(row), 20_000):
                part = slice(start, start + 20_000)
                # The closest is the row itself.
                d = _closest(x[part], y[part], x, y, k)[:, 1:]
                away = [reached(*args, current) for args in zip(x[part], y[part], d[:, -1], strict=True)]
                lists = [pa.array(d.tolist(), pa.list_(pa.float64())), pa.array(away, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(row[part]), pa.array(x[part]), pa.array(y[part]), *lists], ["row", "x", "y", "near", "away"])

        for cell, _, columns in runs(batches):
            if cell != current and held:
                yield from answer()
                held = []
            current = cell
            held.append(columns)
        if held:
            yield from answer()

    def visit(batches):
        held, current, ready = [], None, None
        for cell, kind, columns in runs(batches):
            if cell != current:
                held, current, ready = [], cell, None
            if kind == 0:
                held.append(columns)
            elif held:
                if ready is None:
                    ready = [np.concatenate(c) for c in zip(*held, strict=True)]
                d = _closest(columns[1], columns[2], ready[1], ready[2], k)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(d.tolist(), pa.list_(pa.float64()))], ["row", "near"])

    marked = placed.withColumn("kind", F.lit(0))
    local = marked.repartition("cell").sortWithinPartitions("cell")
    first = _written(local.mapInArrow(own, "row bigint, x double, y double, near array<double>, away array<int>"), "own-cells")
    visitors = first.select("row", "x", "y", F.explode("away").alias("cell"), F.lit(1).alias("kind"))
    met = marked.unionByName(visitors).repartition("cell").sortWithinPartitions("cell", "kind")
    more = met.mapInArrow(visit, "row bigint, near array<double>")
    every = first.select("row", "x", "y", "near").unionByName(more, allowMissingColumns=True)
    merged = every.groupBy("row").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("row", "x", "y", F.array_sort("near")[k - 1].alias("r"))


def digamma(x: Column) -> Column:
    """psi of positive numbers: ten steps of the recurrence, then the asymptotic series."""
    y = x + 10
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4))) - 1 / (252 * F.pow(y, F.lit(6)))
    return series - sum((1 / (x + i) for i in range(1, 10)), 1 / x)


def _closer_rows(radii: DataFrame, limit: int) -> DataFrame:
    """(axis, c, n): how many rows have c rows, themselves included, closer than their radius in one coordinate."""
    cells = []
    for axis in ("x", "y"):
        value = F.col(axis)
        # An upper end comes before the rows at its place, a lower end after them: neither counts them.
        for kind, at in ((0, value + F.col("r")), (1, value), (2, value - F.col("r"))):
            cells.append(F.struct(F.lit(axis).alias("axis"), at.alias("at"), F.lit(kind).alias("kind"), F.col("row").alias("row")))
    events = radii.select(F.inline(F.array(*cells))).withColumn("one", (F.col("kind") == 1).cast("bigint"))
    ordered = Ordered(events, ["at", "kind", "row"], ["axis"], limit).running_sum("one", "upto")
    sides = [F.max(F.when(F.col("kind") == side, F.col("upto"))) for side in (0, 2)]
    counts = ordered.df.where("kind <> 1").groupBy("axis", "row").agg((sides[0] - sides[1]).alias("c"))
    return counts.groupBy("axis", "c").agg(F.count(F.lit(1)).alias("n"))


def knn_mutual_information(
    df: DataFrame, a: str, b: str, key: Sequence[str], k: int = 3, cell_rows: int = CELL_ROWS, limit: int = WINDOW_LIMIT
) -> DataFrame:
    """One row (mi, n): the estimate in nats, at least 0, over the n rows where both numbers are present.

    ``key`` names every row and breaks ties. With no more than k rows the estimate is 0.
    """
    rows = _scaled(df, a, b, key).withColumn("row", F.monotonically_increasing_id())
    radii = neighbour_distances(_written(rows, "points"), k, cell_rows).where(F.col("r") < F.lit(float("inf")))
    # Just inside the k-th neighbour, which is not counted itself.
    counts = _closer_rows(radii.withColumn("r", F.col("r") * (1 - 1e-9)), limit)
    sums = counts.agg(F.sum(F.col("n") * digamma(F.col("c"))).alias("psi"), (F.sum("n") / 2).alias("n"))
    mi = digamma(F.col("n")) + digamma(F.lit(float(k))) - F.col("psi") / F.col("n")
    kept = F.coalesce(F.when(F.col("n") > k, F.greatest(mi, F.lit(0.0))), F.lit(0.0))
    return sums.select(kept.alias("mi"), F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
