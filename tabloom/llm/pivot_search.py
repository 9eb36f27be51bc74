"""Exact nearest rows by inner product, with an index keyed by nearest pivot and distance to it.

Entries become whole numbers floor(scale * c). With R the greatest length of a row, a row v is extended by
sqrt(R^2 - |v|^2) and a query q by 0; then |q' - v'|^2 = |q|^2 + R^2 - 2 q.v, so the largest inner products are the
smallest distances, and the triangle inequality holds for them.

Index: pivots come from a bounded sample (`Settings.sample` rows by hash, centred by a few rounds of k-means). Every
row is keyed by its nearest pivot and its distance r to it, and filed in a ring of similar distances; a ring that
holds more rows than a chunk is dealt over several chunks, so a vector that a third of the rows share is no hot key.
Within a chunk rows are sorted by r.

Search, in two rounds. A row at distance r from a pivot is at least |d(q, pivot) - r| away from q. First each query
looks at one chunk of the rings with the smallest such bounds until these hold ``first_rows`` rows; the k-th best
score found gives its reach. Then it goes to all other chunks of rings whose bound lies within the reach, and there to
the annulus of rows with |d(q, pivot) - r| <= reach alone; everything else is out by the triangle inequality. Bounds
are widened by far more than the rounding of doubles, and scores are whole numbers, so the answer is exact whatever
the pivots are.

Chunks and queries meet in sorted partitions: the rows of a chunk come first and stay in memory, queries stream by.
More than ``lane_queries`` queries are spread over several lanes, each with its own copy of the chunks. Only facts per
ring (pivots x rings at most) reach the driver.

Defined cases: rows without identifier and rows whose vector is null, empty, holds a null or a non-finite entry, has
another length than the commonest, or entries so large that an inner product could leave 64 bits take no part; a
query is never answered with rows of its own identifier; each repeated row is a candidate of its own, and a query of
its own; ties go to the smaller identifier; fewer than k candidates give them all; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.llm.common import stored
from tabloom.llm.vectors import commonest_length, usable, whole

#: Bits of a row's salt; a ring is dealt over at most so many chunks.
_SALT = 2**20
_BLOCK = 256


@dataclass(frozen=True)
class Settings:
    scale: int = 1024
    pivots: int = 32
    #: Rows that pivots and ring borders are learned from; every row is indexed.
    sample: int = 8192
    rings: int = 64
    chunk_rows: int = 16_384
    first_rows: int = 4_096
    lane_queries: int = 65_536


@dataclass(frozen=True)
class Geometry:
    """What the tasks know: dimension, number format, the radius, pivots (extended) and ring borders."""

    d: int
    kind: str
    radius: float
    pivots: np.ndarray
    borders: tuple[np.ndarray, ...]

    def extended(self, y: np.ndarray) -> np.ndarray:
        f = y.astype(np.float64)
        rest = np.maximum(self.radius**2 - (f * f).sum(axis=1), 0.0)
        return np.column_stack((f, np.sqrt(rest)))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """Distances of extended points to all pivots, from differences (no cancellation)."""
        return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def slack(self, y: np.ndarray) -> np.ndarray:
        return 1e-9 * (self.radius + np.sqrt((y.astype(np.float64) ** 2).sum(axis=1)) + 1.0)


@dataclass(frozen=True)
class Rings:
    """Facts per ring that holds rows."""

    pivot: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    parts: np.ndarray


@dataclass(frozen=True)
class Index:
    """The keyed rows (a stored table: id, pivot, ring, r, salt, vec), their rings and their geometry."""

    rows: DataFrame
    rings: Rings
    geometry: Geometry | None
    settings: Settings
    n: int


def _nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots * pivots).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)


def choose_pivots(points: np.ndarray, wanted: int, rounds: int = 6) -> np.ndarray:
    """Centres of the sample: far apart at first, then a few rounds of k-means."""
    chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < wanted and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    pivots = points[chosen].copy()
    for _ in range(rounds):
        home = _nearest(points, pivots)
        for i in range(len(pivots)):
            if (home == i).any():
                pivots[i] = points[home == i].mean(axis=0)
    return pivots


def _limit(d: int, scale: int) -> float:
    """Entries below this give inner products within 63 bits."""
    return ((2.0**62 / d) ** 0.5) / scale


def _identified(df: DataFrame, id_col: str, vector: str, d: int, scale: int) -> DataFrame:
    rows = usable(df.select(col(id_col).cast("bigint").alias("id"), col(vector).alias("v")), "v", _limit(d, scale))
    return rows.where((F.size("v") == d) & F.col("id").isNotNull())


def build(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> Index:
    """Index every usable row of ``df``."""
    spark, scale = df.sparkSession, settings.scale
    d = commonest_length(usable(df.select(col(vector)), vector, float("inf")), vector)
    none = Rings(*[np.zeros(0, t) for t in (np.int64, np.int64, float, float, np.int64, np.int64)])
    if not d:
        return Index(spark.createDataFrame([], "id bigint"), none, None, settings, 0)
    rows = _identified(df, id_col, vector, d, scale)

    def extent(batches):
        n, longest, largest = 0, 0.0, 0
        for batch in batches:
            y = whole(batch.column(1), d, scale)
            if len(y):
                n += len(y)
                longest = max(longest, float((y.astype(np.float64) ** 2).sum(axis=1).max()))
                largest = max(largest, int(np.abs(y).max()))
        columns = [pa.array([n], pa.int64()), pa.array([longest]), pa.array([largest], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["n", "longest", "largest"])

    facts = rows.mapInArrow(extent, "n bigint, longest double, largest bigint")
    facts = facts.agg(F.sum("n").alias("n"), F.max("longest").alias("longest"), F.max("largest").alias("largest")).first()
    if not facts["n"]:
        return Index(spark.createDataFrame([], "id bigint"), none, None, settings, 0)
    kind = "<i2" if facts["largest"] < 2**15 else "<i4" if facts["largest"] < 2**31 else "<i8"
    radius = facts["longest"] ** 0.5 * (1 + 1e-12)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(settings.sample).select("v").toArrow()["v"].combine_chunks()
    bare = Geometry(d, kind, radius, np.zeros((0, d + 1)), ())
    points = bare.extended(whole(sample, d, scale))
    pivots = choose_pivots(points, settings.pivots)
    geometry = Geometry(d, kind, radius, pivots, _ring_borders(points, pivots, facts["n"], settings))

    def key(batches):
        for batch in batches:
            y = whole(batch.column(1), d, scale)
            if not len(y):
                continue
            points = geometry.extended(y)
            home = _nearest(points, geometry.pivots)
            r = np.sqrt(((points - geometry.pivots[home]) ** 2).sum(axis=1))
            ring = np.zeros(len(y), np.int32)
            for i in np.unique(home):
                mine = home == i
                ring[mine] = np.searchsorted(geometry.borders[i], r[mine], "right")
            columns = [batch.column(0), pa.array(home.astype(np.int32)), pa.array(ring), pa.array(r), _packed(y, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "pivot", "ring", "r", "vec"])

    keyed = rows.mapInArrow(key, "id bigint, pivot int, ring int, r double, vec binary")
    # The salt is written with the row, so later stages and reruns see the same one.
    table = stored(keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(_SALT)).cast("int")), "pivot-index")
    counted = table.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    found = counted.orderBy("pivot", "ring").collect()
    size = np.array([r["n"] for r in found], np.int64)
    rings = Rings(
        np.array([r["pivot"] for r in found], np.int64), np.array([r["ring"] for r in found], np.int64),
        np.array([r["low"] for r in found]), np.array([r["high"] for r in found]), size,
        np.minimum(-(-size // settings.chunk_rows), _SALT),
    )
    return Index(table, rings, geometry, settings, facts["n"])


def _ring_borders(points: np.ndarray, pivots: np.ndarray, n: int, settings: Settings) -> tuple[np.ndarray, ...]:
    """Distances that cut each pivot's rows into rings of about a chunk, learned from the sample."""
    home = _nearest(points, pivots)
    borders = []
    for i, p in enumerate(pivots):
        r = np.sort(np.sqrt(((points[home == i] - p) ** 2).sum(axis=1)))
        rings = int(min(settings.rings, max(1, n * len(r) // max(1, len(points)) // settings.chunk_rows)))
        cuts = [r[len(r) * j // rings] for j in range(1, rings)] if len(r) else []
        borders.append(np.unique(np.array(cuts, np.float64)))
    return tuple(borders)


def _packed(y: np.ndarray, kind: str) -> pa.Array:
    raw = y.astype(kind)
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * raw.dtype.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def _unpacked(column: pa.Array, d: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d).astype(np.float64)


def _first_rings(bounds: np.ndarray, rings: Rings, wanted: int, chunk: int) -> np.ndarray:
    """Rings whose first chunk a query looks at in the first round: the closest ones, up to ``wanted`` rows."""
    order = np.argsort(bounds, kind="stable")
    held = np.cumsum(np.minimum(rings.rows[order] // rings.parts[order] + 1, chunk))
    return order[: int(np.searchsorted(held, wanted, "left")) + 1]


def _planned(queries: DataFrame, index: Index, final: bool) -> DataFrame:
    """One row per query and chunk that it has to visit: in the first round, or in the ``final`` one by its reach."""
    g, rings, s = index.geometry, index.rings, index.settings
    base = rings.pivot

    def plan(batches):
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(start, 1000)
                y = _unpacked(batch.column(2), g.d, g.kind)
                to_pivots = g.distances(np.column_stack((y, np.zeros(len(y)))))
                slack = g.slack(y)
                lengths = (y * y).sum(axis=1)
                floors = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
                rows, cells, parts, reaches = [], [], [], []
                for i in range(len(y)):
                    away = to_pivots[i][base]
                    bounds = np.maximum(np.maximum(away - rings.high, rings.low - away), 0.0)
                    first = _first_rings(bounds, rings, s.first_rows, s.chunk_rows)
                    if not final:
                        cell, part, reach = first, np.zeros(len(first), np.int64), np.inf
                    else:
                        reach = np.inf
                        if np.isfinite(floors[i]):
                            reach = np.sqrt(max(lengths[i] + g.radius**2 - 2 * floors[i], 0.0)) + slack[i]
                        near = np.flatnonzero(bounds <= reach)
                        cell = np.repeat(near, rings.parts[near])
                        begin = np.repeat(np.cumsum(rings.parts[near]) - rings.parts[near], rings.parts[near])
                        part = np.arange(len(cell)) - begin
                        fresh = ~(np.isin(cell, first) & (part == 0))
                        cell, part = cell[fresh], part[fresh]
                    rows.append(np.full(len(cell), i))
                    cells.append(cell)
                    parts.append(part)
                    reaches.append(np.full(len(cell), reach))
                row, cell = np.concatenate(rows).astype(np.int64), np.concatenate(cells).astype(np.int64)
                take = pa.array(row)
                made = [
                    pa.array(rings.pivot[cell].astype(np.int32)), pa.array(rings.ring[cell].astype(np.int32)),
                    pa.array(np.concatenate(parts).astype(np.int32)), pa.array(to_pivots[row, rings.pivot[cell]]),
                    pa.array(np.concatenate(reaches)),
                ]
                kept = [batch.column(i).take(take) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names)

    names = ["query", "id", "vec", "floor", "pivot", "ring", "part", "r", "reach"]
    schema = "query bigint, id bigint, vec binary, floor bigint, pivot int, ring int, part int, r double, reach double"
    return queries.select("query", "id", "vec", "floor").mapInArrow(plan, schema)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, floor: float, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller identifiers, none below ``floor`` and none of ``own``."""
    fit = np.flatnonzero(scores >= floor) if np.isfinite(floor) else np.arange(len(scores))
    fit = fit[ids[fit] != own]
    if len(fit) > k:
        least = np.partition(scores[fit], len(fit) - k)[len(fit) - k]
        fit = fit[scores[fit] >= least]
    return fit[np.lexsort((ids[fit], -scores[fit]))[:k]]


def _visit(index: Index, plan: DataFrame, lanes: int, k: int, first: bool) -> DataFrame:
    """Candidates (query, id, score) of the planned visits, at most k per visit."""
    g, rings = index.geometry, index.rings
    spark = plan.sparkSession
    facts = [(int(p), int(r), int(n)) for p, r, n in zip(rings.pivot, rings.ring, rings.parts, strict=True)]
    parts = F.broadcast(spark.createDataFrame(facts, "pivot int, ring int, parts int"))
    rows = index.rows.join(parts, ["pivot", "ring"]).withColumn("part", F.pmod("salt", "parts").cast("int"))
    if first:
        rows = rows.where("part = 0")
    lane = F.pmod(F.xxhash64("query"), F.lit(lanes)).cast("int")
    rows = rows.select(
        "pivot", "ring", "part", F.explode(F.array(*[F.lit(i) for i in range(lanes)])).alias("lane"), F.lit(0).alias("kind"), "r",
        F.lit(None).cast("bigint").alias("query"), "id", "vec", F.lit(None).cast("bigint").alias("floor"),
        F.lit(None).cast("double").alias("reach"),
    )
    asked = plan.select("pivot", "ring", "part", lane.alias("lane"), F.lit(1).alias("kind"), "r", "query", "id", "vec", "floor", "reach")
    keys = ["pivot", "ring", "part", "lane"]
    met = rows.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "r")

    def score(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        chunk, ready = None, None
        for batch in batches:
            place = np.column_stack([batch.column(i).to_numpy() for i in range(5)])
            edges = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(place)], strict=True):
                if start == stop:
                    continue
                part = batch.slice(start, stop - start)
                name, kind = tuple(place[start, :4].tolist()), place[start, 4]
                if name != chunk:
                    chunk, held, ready = name, [], None
                if kind == 0:
                    held.append((part.column(5).to_numpy(), part.column(7).to_numpy(), _unpacked(part.column(8), g.d, g.kind)))
                elif held:
                    if ready is None:
                        ready = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield from _answers(part, *ready)

    def _answers(part: pa.RecordBatch, r: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        top = np.abs(x).max(initial=0)
        for start in range(0, part.num_rows, _BLOCK):
            asked = part.slice(start, _BLOCK)
            q = _unpacked(asked.column(8), g.d, g.kind)
            away, reach = asked.column(5).to_numpy(), asked.column(10).to_numpy()
            low, high = np.searchsorted(r, away - reach, "left"), np.searchsorted(r, away + reach, "right")
            a, b = int(low.min()), int(high.max())
            if b <= a:
                continue
            if top * np.abs(q).max(initial=0) * g.d < 2**53:
                scores = q @ x[a:b].T
            else:
                scores = q.astype(np.int64) @ x[a:b].astype(np.int64).T
            numbers, own = asked.column(6).to_numpy(), asked.column(7).to_numpy()
            floors = asked.column(9).to_numpy(zero_copy_only=False).astype(np.float64)
            found = [(i, _best(scores[i], ids[a:b], own[i], floors[i], k)) for i in range(len(q))]
            rows = np.repeat([i for i, _ in found], [len(at) for _, at in found])
            at = np.concatenate([at for _, at in found])
            columns = [pa.array(numbers[rows]), pa.array(ids[a:b][at]), pa.array(scores[rows, at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "id", "score"])

    return met.mapInArrow(score, "query bigint, id bigint, score bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score) of the k best rows per query. ``queries`` holds id and vec as in ``index.rows``."""
    spark = queries.sparkSession
    if not index.n:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    asked = stored(queries.select("id", "vec", F.monotonically_increasing_id().alias("query")), "queries")
    lanes = max(1, -(-asked.count() // index.settings.lane_queries))
    blank = asked.withColumn("floor", F.lit(None).cast("bigint"))
    first = stored(_top(_visit(index, _planned(blank, index, False), lanes, k, True), k), "first-round")
    floors = first.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    reached = asked.join(floors, "query", "left")
    later = _visit(index, _planned(reached, index, True), lanes, k, False)
    best = _top(first.select("query", "id", "score").unionByName(later), k)
    names = asked.select("query", F.col("id").alias("query_id"))
    return best.join(names, "query").select("query_id", "rank", "id", "score")


def nearest_rows(
    df: DataFrame, chosen: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, settings: Settings = Settings()
) -> DataFrame:
    """The k best other rows of ``df`` for each of its rows whose identifier (named ``id``) meets ``chosen``."""
    index = build(df, id_col, vector, settings)
    return search(index, index.rows.where(chosen) if index.n else index.rows, k)
