import re

import brute
import corpus_pipeline as P
from test_packing_bpe import check_packing
from tokenizers import Tokenizer

from tabloom.llm.bpe import vocabulary_path


def test_stages_against_brute_force(spark, sf_dir):
    """Each stage on its own input; the packed pieces hold every token of the last texts."""
    library = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    out = P.quality_rules(spark, docs, sf_dir)
    assert out.columns == names
    fine = brute.quality_kept([(r.doc_id, r.text, r.source) for r in rows.values()])
    kept = {d: r for d, r in rows.items() if d in fine}
    assert {r.doc_id: r for r in out.collect()} == kept

    out = P.exact_duplicates(spark, out, sf_dir)
    first = {}
    for d in sorted(kept):
        first.setdefault(brute.lower(kept[d].text), d)
    kept = {d: kept[d] for d in first.values()}
    assert out.columns == names and {r.doc_id: r for r in out.collect()} == kept

    out = P.near_duplicates(spark, out, sf_dir)
    prints = {d: brute.fingerprint(r.text) for d, r in kept.items()}
    root = brute.near_components(prints.values())
    first = {}
    for d in sorted(kept):
        first.setdefault(root[prints[d]], d)
    kept = {d: kept[d] for d in first.values()}
    assert out.columns == names and {r.doc_id: r for r in out.collect()} == kept

    out = P.personal_data(spark, out, sf_dir)
    assert out.columns == names
    last = {r.doc_id: r.text for r in out.collect()}
    assert set(last) == set(kept)
    assert all(last[d] == kept[d].text for d in kept if not re.search(r"[@\d]", kept[d].text))
    assert {r.doc_id: r.n_chars for r in out.collect()} == {d: len(t) for d, t in last.items()}

    tokens = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in last.items()}
    packed = P.packed_sequences(spark, out, sf_dir).collect()
    assert check_packing(packed, tokens) <= -(-sum(map(len, tokens.values())) // 4096) * 1.02 + 1
    whole = P.run(spark, sf_dir).collect()
    assert check_packing(whole, tokens) <= -(-sum(map(len, tokens.values())) // 4096) * 1.02 + 1


def test_empty_and_odd_tables(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", None, None, None), (2, "a b", None, None, None)]
    long = " ".join(f"w{i}" for i in range(40_000))
    rows += [(3, long, "en", "s", 1), (3, long, "en", "s", 1), (None, long + " mail me@x.org", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame, n in ((df, None), (df.limit(0), 0)):
        for _, stage in P.STAGES:
            assert stage(spark, frame, sf_dir).count() >= 0
            if n == 0:
                assert stage(spark, frame, sf_dir).count() == 0
    docs = df
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert sorted(r.doc_id or 0 for r in docs.collect()) in ([0, 3], [3])
