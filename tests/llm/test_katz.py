import brute
import pytest

from tabloom.llm import katz


def check(rows, docs, model):
    by_id = {}
    for d, text in docs:
        by_id.setdefault((d, text), model.score(text))
    assert len(rows) == len(docs)
    for r in rows:
        n, known, base, score = by_id[r.doc_id, r.text]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, model.n, model.held(r.doc_id))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("group,bucket", [(1_000_000, 2_000_000), (3_000, 5_000)])
def test_scores_equal_brute_force(spark, sf_dir, monkeypatch, group, bucket):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket)
    if group < 10_000:
        original = katz.groups
        monkeypatch.setattr(katz, "groups", lambda batches, limit=group: original(batches, limit))
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(3, "doc_id")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    check(katz.scored(df).collect(), docs, brute.Katz(docs))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "A b a b"), (3, "A b a b"), (None, "c c c"), (4, "a " * 60_000), (5, "a b c"), (36, "b d a"), (7, "a B")]
    df = spark.createDataFrame([(d, t, "own") for d, t in docs], "doc_id long, text string, score string")
    out = katz.scored(df)
    check(out.collect(), docs, brute.Katz(docs))
    assert katz.scored(df.limit(0)).count() == 0
    lone = [r.doc_id for r in out.filter("held_out").collect()][:1]
    if lone:
        only = df.filter(f"doc_id = {lone[0]}")
        found = katz.scored(only).collect()
        assert found[0].train_tokens == 0 and found[0].n_known == 0


def test_probabilities_sum_to_one(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    model = brute.Katz(docs)
    for h in list(model.context)[:30]:
        assert sum(model.p2(h, w) for w in model.uni) + model.p2(h, "unknown") == pytest.approx(1, abs=1e-9)


def test_held_out_texts_score_above_the_base(spark, sf_dir):
    from tabloom.llm.queries import op5_katz_scores

    rows = op5_katz_scores(spark, sf_dir).filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("n", [[0, 10, 5, 3, 2, 1, 1], [0, 1, 2, 3, 4, 5, 6], [0, 7, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0], [0, 9, 9, 9, 9, 9, 9], [0, 0, 3, 0, 8, 0, 1]])
def test_discounts_are_valid_on_every_corpus(n):
    import numpy as np

    low = katz.discounted(np.array(n))
    assert low[0] == 0 and all(0 < low[r] < r for r in range(1, 6)) and (np.diff(low) > 0).all()


def test_discounts_follow_the_counts_of_counts():
    """Exactly falling counts of counts are their own line: Good-Turing without any smoothing."""
    import numpy as np

    n = np.array([0, *[1e6 / r**2 for r in range(1, 7)]])
    cut = 6 * n[6] / n[1]
    want = [((r + 1) * n[r + 1] / n[r] - r * cut) / (1 - cut) for r in range(1, 6)]
    assert katz.discounted(n)[1:] == pytest.approx(want)
