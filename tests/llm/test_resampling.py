"""Importance resampling against a plain version with dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from tabloom.catalog.registry import QUERIES
from tabloom.llm import queries as _queries  # noqa: F401
from tabloom.llm import resampling as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(brute.lower(text))
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target, percent=5, least=20):
    """doc_id -> (n_features, weight, score, rank); doc_ids are unique."""
    s = Counter(bucket(f) for _, t in docs for f in features(t)[0])
    t = Counter(bucket(f) for x in target for f in features(x)[0])
    s_all, t_all = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(10_000)]
    rows, able = {}, []
    for d, text in docs:
        found, n = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[d] = [len(found), weight, score, None]
        if n >= least:
            able.append(d)
    able.sort(key=lambda d: (-rows[d][2], d))
    for i, d in enumerate(able[: percent * len(able) // 100]):
        rows[d][3] = i + 1
    return {d: tuple(r) for d, r in rows.items()}


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = QUERIES["op11_importance_resampling"](spark, sf_dir)
    assert dict(found.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    rows = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()}
    assert rows == plain(docs, target)
    assert sum(r[3] is not None for r in rows.values()) > 3


def test_hashes_of_runs_over_any_cuts():
    rng = random.Random(5)
    parts = ["abc", "Zed", "öl", "q" * 64, "r" * 65, "s" * 900, "1", "x_y", "ä" * 40]
    texts = ["", "   ", "A,B;c"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(30)]
    raw = [t.encode() for t in texts]
    for piece, words in ((30, 3), (500, 50), (2_000_000, 300_000)):
        found = [Counter() for _ in texts]
        for who, codes in R.runs(*R.word_codes(raw, piece), 3, words):
            for i, c in zip(who.tolist(), codes.tolist(), strict=True):
                found[i][c] += 1
        assert found == [Counter(zlib.crc32(f.encode()) for f in features(t)[0]) for t in texts]


@pytest.mark.parametrize("low,high", [(-9000, 9000), (0, 3), (-1, 0), (0, 0), (-(2**20), 2**20)])
def test_bit_planes_give_exact_products(low, high):
    rng = np.random.default_rng(3)
    gain = rng.integers(low, high + 1, 1000)
    planes = R.GainPlanes.of(gain.tolist())
    counts = rng.integers(0, 4, (50, planes.width)) * rng.integers(0, 2, (50, planes.width))
    counts[0, 7], counts[1], counts[:, 1000:] = 123_456, 0, 0
    assert planes.weights(counts).tolist() == (counts[:, :1000] @ gain).tolist()


def test_defined_cases(spark):
    long = " ".join(f"word{i % 977}" for i in range(400_000))
    docs = [(1, None), (2, ""), (3, long), (4, "alpha beta " * 15), (5, "alpha beta " * 15), (6, "short one"), (7, "A-B é " * 20)]
    frame = spark.createDataFrame([(d, t, "x", 9, 8) for d, t in docs], "doc_id long, text string, rank string, weight int, _part int")
    target = spark.createDataFrame([("alpha beta gamma",), (None,)], "text string")
    wide = R.Settings(percent=60)
    want = plain(docs, ["alpha beta gamma", None], percent=60)
    found = R.scored(frame, target, settings=wide)
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()} == want
    assert {r.own_rank for r in found.collect()} == {"x"} and {r.own_weight for r in found.collect()} == {9}
    drawn = R.resampled(frame, target, settings=wide)
    assert drawn.columns == frame.columns
    assert {r.doc_id for r in drawn.collect()} == {d for d, r in want.items() if r[3]}

    twice = frame.unionByName(frame.where("doc_id = 4")).unionByName(spark.createDataFrame([(None, "b " * 30, "x", 1, 1)], frame.schema))
    again = R.scored(twice, target, settings=R.Settings(percent=100)).collect()
    assert sorted(r["rank"] for r in again if r["rank"]) == [1, 2, 3, 4, 5, 6]
    copies = [r for r in again if r.doc_id == 4]
    assert len(copies) == 2 and copies[0].weight == copies[1].weight and copies[0].score == copies[1].score

    empty = frame.where("false")
    assert R.scored(empty, target).count() == 0 and R.resampled(empty, target).columns == frame.columns
    assert R.scored(frame, target.where("false")).count() == 7
