import random

import brute
import pytest
from pyspark.sql import functions as F

from tabloom.llm import simhash_dedup as S

UNSIGNED = 1 << 64


def signed(x):
    return x - UNSIGNED if x >= 1 << 63 else x


def test_query_equals_brute_force(spark, sf_dir):
    from tabloom.llm.queries import op3_simhash_dedup

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: brute.fingerprint(t) for d, t in docs.items()}
    root = brute.near_components(prints.values())
    name = {}
    for d, p in prints.items():
        name[root[p]] = min(d, name.get(root[p], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash_dedup(spark, sf_dir).collect()}
    assert got == {d: (f"{p:016x}", name[root[p]]) for d, p in prints.items()}


@pytest.mark.parametrize("k,limit", [(2, 64), (2, 1), (1, 64), (1, 1)])
def test_links_connect_exactly_the_near_prints(spark, k, limit):
    rng = random.Random(k * 10 + limit)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.add(p)
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    rows = S.links(frame, S.Search(k=k, key_limit=limit)).collect()
    got = brute.roots([signed(p) for p in prints], [(r.a, r.b) for r in rows])
    want = brute.roots(
        [signed(p) for p in prints],
        [(signed(a), signed(b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= k],
    )
    assert got == want
    labels = {r.node: r.root for r in S.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert labels == {n: want[n] for n in labels} and set(labels) == {x for r in rows for x in r}


def test_edges(spark):
    rows = [
        (1, None, "a"), (2, "", "b"), (3, "one two", "c"), (3, "one two", "c"), (None, "ONE two", "d"),
        (7, "word " * 50_000, "e"), (9, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    found = S.survivors(df)
    assert found.columns == df.columns
    assert sorted((r.doc_id, r.fingerprint) for r in found.collect()) == [(1, "a"), (3, "c"), (7, "e")]
    assert S.survivors(df.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, "x y z")], "doc_id long, text string")
    assert S.survivors(only_null).count() == 1


def test_thresholds_keep_the_pigeonhole(spark):
    prints = spark.range(500).select(F.xxhash64("id").alias("fp"))
    plan = S.plan_search(prints, S.Search())
    assert sorted(b for p in plan.partitions for b in p) == list(range(64))
    bits = S._bits_of(prints.toArrow().to_batches()[0], "fp")
    limits, _ = plan.thresholds(bits)
    assert ((limits + 1).sum(axis=1) == 3).all()
