import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabloom.llm import bpe, packing, queries

PATH = bpe.vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def check_packing(rows, tokens, capacity=4096):
    pieces, filled = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(tokens)
    for d, ids in tokens.items():
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        for r in own:
            part = ids[r.piece * capacity : (r.piece + 1) * capacity]
            assert (r.start, r.length) == (r.piece * capacity, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_packing_query(spark, sf_dir, library):
    docs = texts_of(spark, sf_dir)
    tokens = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in docs.items()}
    used = check_packing(queries.op1_bestfit_packing(spark, sf_dir).collect(), tokens)
    assert used <= -(-sum(map(len, tokens.values())) // 4096) * 1.02 + 1


def test_packing_edges(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (None, "hello", None), (4, "word " * 30_000, "z"), (4, "word " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = packing.packed_documents(df, keep_ids=True).collect()
    assert sorted(r.length for r in out if r.doc_id in (1, 2)) == [1, 1]
    assert sum(r.length for r in out if r.doc_id == 4) == 2 * 30_001
    assert all(len(r.ids) == r.length for r in out)
    assert packing.packed_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_solver_holds_every_piece_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = [64, 128, 512][seed % 3]
    histogram = np.zeros(capacity + 1, np.int64)
    for length in np.minimum(rng.exponential(capacity / 3, 3000).astype(int) + 1, capacity):
        histogram[length] += rng.integers(1, 50) if seed > 2 else 1
    lots = packing.solve(histogram, capacity)
    held = np.zeros_like(histogram)
    for lot in lots:
        assert lot.filled <= capacity
        for length, times in lot.items:
            held[length] += times * lot.count
    assert (held == histogram).all()
    bound = -(-int((histogram * np.arange(capacity + 1)).sum()) // capacity)
    assert sum(lot.count for lot in lots) <= 1.01 * bound + 1
    plan = packing.plan_of(lots, histogram)
    lengths = np.repeat(np.arange(capacity + 1), histogram)
    ranks = np.concatenate([np.arange(n) for n in histogram])
    sequence, offset = plan.places(lengths, ranks)
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], lengths[order]
    start = np.concatenate([[True], s[1:] != s[:-1]])
    assert (o[start] == 0).all() and (o[1:] == o[:-1] + n[:-1])[~start[1:]].all() and (o + n <= capacity).all()


def test_two_large_lengths_need_their_own_sequences():
    histogram = np.zeros(101, np.int64)
    histogram[[60, 40, 35, 30]] = [10, 10, 4, 8]
    assert sum(lot.count for lot in packing.solve(histogram, 100)) == 14


def test_round_trip_query(spark, sf_dir, library):
    docs = texts_of(spark, sf_dir)
    got = {r.doc_id: r for r in queries.op2_bpe_round_trip(spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for d, text in docs.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def fuzz(n=1500):
    rng = random.Random(7)
    pool = list("abcXYZ 'sS'tredl éèÉßΣσςİıǅ中文日本語한국어🙂🏽👩‍👩 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​0123٣Ⅷ½-_.,!?#$<|>́ﬁ\x00\x7f")
    pool += ["<|endoftext|>", "<|startoftext|>", "the", "ing", "'re", "'ll", "  ", "\n\n"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoding_of_odd_texts(spark, library):
    texts = [*fuzz(), "aab" * 5_000 + "ing" * 900, "x" * 30_000]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, x string")
    out = bpe.decoded(bpe.encoded(df)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(df.limit(0)).count() == 0
    # One pass gives what the two passes give.
    assert [tuple(r) for r in bpe.round_trip(df).collect()] == [tuple(r) for r in out]
    assert bpe.round_trip(df.limit(0)).count() == 0
    assert "own_ids" in bpe.round_trip(df.withColumn("ids", df["text"])).columns


def test_cuts_lie_where_no_token_reaches():
    own = bpe.Encoder(PATH)
    tokens = [t.removesuffix("</w>") for t in own.vocabulary.ids]
    pieces = own.cuts("thqzxjé§¶ing")
    assert len(pieces) > 2
    for a, b in zip(pieces, pieces[1:]):
        assert not any(a[-1] + b[0] in t for t in tokens)
