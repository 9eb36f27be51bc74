"""Exact nearest rows against all inner products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import pivot_search as P


def plain(rows, chosen, k=10, scale=1024):
    """(query_id, rank, id, score) of every chosen row; rows are (id, vector)."""
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, a in fine:
        if chosen(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q)
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(found)


def ask(frame, every, **settings):
    found = P.nearest_rows(frame, F.col("id") % every == 0, settings=P.Settings(**settings))
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect())


@pytest.mark.parametrize(
    "settings",
    [{}, {"pivots": 3, "chunk_rows": 40, "first_rows": 30, "rings": 5}, {"pivots": 1, "chunk_rows": 7, "first_rows": 1, "lane_queries": 9}],
    ids=["as registered", "small chunks", "one pivot, lanes"],
)
def test_clustered_rows_with_a_hot_vector(spark, settings):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(900):
        c = centres[i % 8]
        rows.append((i, centres[0] if i % 3 == 0 else [x * rng.choice([0.2, 1, 3]) + rng.gauss(0, 0.05) for x in c]))
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(7)
    assert ask(frame, 10, **settings) == plain(rows, lambda q: q % 10 == 0)


def test_bounds_leave_most_rows_out(spark):
    """Tight clusters: the second round visits few chunks."""
    rng = random.Random(2)
    rows = [(i, [(j == i % 16) + rng.gauss(0, 0.001) for j in range(16)]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    index = P.build(frame, settings=P.Settings(pivots=16, chunk_rows=200, first_rows=300))
    queries = index.rows.where("id % 100 = 0").withColumn("query", F.col("id"))
    floors = {q: s for q, rank, _, s in plain(rows, lambda q: q % 100 == 0) if rank == 10}
    given = spark.createDataFrame(list(floors.items()), "query bigint, floor bigint")
    visits = P._planned(queries.join(given, "query"), index, True).count()
    chunks = int(index.rings.parts.sum())
    assert chunks >= 16 and visits < 0.25 * chunks * len(floors)
    assert ask(frame, 100, pivots=16, chunk_rows=200, first_rows=300) == plain(rows, lambda q: q % 100 == 0)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -1.0]), (3, [0.0, 0.0]), (-4, [1.0, 2.0]), (100, [2.0, 0.1])]
    bad = [(5, None), (6, []), (7, [nan, 1.0]), (8, [1.0, inf]), (9, [None, 1.0]), (None, [9.0, 9.0]), (11, [1.0]), (12, [1e300, 1.0])]
    schema = "vec_id int, embedding array<double>, score string, query string"
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + bad], schema)
    assert ask(frame, 1) == plain(rows, lambda q: True)

    twice = frame.unionByName(frame.where("vec_id = 1"))
    found = [r for r in ask(twice, 100) if r[0] == 0]
    assert [r[2] for r in found].count(1) == 2 and len(found) == 6
    again = ask(twice, 1)
    assert [r for r in again if r[0] == 1 and r[1] == 1] == [(1, 1, -4, (1024**2) * 5)] * 2
    assert not [r for r in again if r[0] == r[2]]

    empty = P.nearest_rows(frame.where("false"), F.col("id") % 2 == 0)
    assert empty.columns == ["query_id", "rank", "id", "score"] and empty.count() == 0
    assert ask(frame.where("vec_id = 0"), 1) == []
    assert ask(spark.createDataFrame([(i, v, "", "") for i, v in bad[:5]], schema), 1) == []


def test_large_entries_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-(10**5), 10**5)) for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert ask(frame, 5, pivots=4, chunk_rows=10, first_rows=12) == plain(rows, lambda q: q % 5 == 0)


def test_scores_beyond_doubles():
    scores = np.array([2**60 + 1, 2**60 + 2, 2**60, 5], np.int64)
    assert P._best(scores, np.array([1, 2, 3, 4]), 9, float("nan"), 2).tolist() == [1, 0]
