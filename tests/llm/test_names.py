"""Columns of the input that are called like results or helpers come back as own_<name>."""

import pytest

from tabloom.llm import bpe, exact_dedup, katz, packing, simhash_dedup, token_counts
from tabloom.llm.common import stored


@pytest.fixture
def docs(spark):
    rows = [(i, f"some words of text {i % 3} and more", "mine") for i in range(6)]
    return lambda name: spark.createDataFrame(rows, f"doc_id long, text string, {name} string")


def calls():
    return {
        "packing": (packing.packed_documents, ["sequence_id", "length_", "offset", "ids", "piece", "bucket_"]),
        "encoded": (bpe.encoded, ["ids"]),
        "decoded": (lambda df: bpe.decoded(bpe.encoded(df)), ["decoded"]),
        "simhash": (lambda df: simhash_dedup.with_components(stored(simhash_dedup.with_fingerprints(df), "f")), ["name_", "root_", "component_id"]),
        "katz": (katz.scored, ["ref", "score", "held_out"]),
        "exact": (exact_dedup.deduplicated, ["group_keep", "keep_id", "group_rows"]),
        "counts": (token_counts.counted, ["n_tokens"]),
    }


@pytest.mark.parametrize("call", list(calls()))
def test_clashing_names(docs, call):
    run, names = calls()[call]
    plain = run(docs("other"))
    for name in names:
        found = run(docs(name))
        assert {r[0] for r in found.select(f"own_{name}").collect()} == {"mine"}
        assert sorted(c for c in found.columns if c != f"own_{name}") == sorted(c for c in plain.columns if c != "other")
        assert found.count() == plain.count()
