import io
import random
import struct
from pathlib import Path

import pytest
import zstandard
from compare import connect, differences
from test_packing_bpe import fuzz
from tokenizers import Tokenizer

from tabloom.llm import bpe, queries, token_counts, url_rules, warc
from tabloom.llm.common import stored
from tabloom.session import scratch_path


@pytest.mark.parametrize("name,sql", [("op4_warc_round_trip", queries.WARC_SQL), ("op9_url_filters", queries.URL_SQL)])
def test_equals_sql(spark, sf_dir, name, sql):
    assert differences(getattr(queries, name)(spark, sf_dir), connect(sf_dir), sql) == []


PAGES = [
    (1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (5, None, "same"), (3, "http://c/", None), (4, "", ""),
    (None, "http://d/", "lone"), (7, "u", "é" * 100_000), (9, "u", "<p>\r\n\r\n</p>"), (9, "u", "<p>\r\n\r\n</p>"), (None, "n", "same"),
]


def test_archive_edges(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    rows = warc.archived(df).collect()
    assert len(rows) == len(PAGES)
    got = {}
    for r in rows:
        got.setdefault(r.record_key, []).append((r.record_type, r.refers_to_key, r.payload_bytes))
    assert got["5"] == [("response", None, 4)] and got["1"] == got["2"] == [("revisit", "5", 4)]
    assert got["4"] == [("response", None, 0)] and got["3"] == [("revisit", "4", 0)]
    assert got["9"] == [("response", None, 11)] * 2 and got["7"] == [("response", None, 200_000)]
    assert sorted(got[None]) == [("response", None, 4), ("revisit", "5", 4)]
    assert warc.archived(df.limit(0)).count() == 0
    folder = scratch_path(spark, "warc-small")
    small = warc.write(warc.marked(df, "page_id", "html", least_bytes=1), folder, archive_bytes=100)
    assert small.count() == len(PAGES)
    full = stored(warc.read(small), "records").collect()
    assert {bytes(r.payload).decode() for r in full if r.record_key == "9"} == {"<p>\r\n\r\n</p>"}
    assert {r.record_type for r in full if r.record_key in ("3", "4")} == {"response"}
    assert {r.target_uri for r in full if r.record_key == "2"} == {"http://b/%0D%0AX:%20y"}


def archive_of(records):
    out = io.BytesIO()
    packer = zstandard.ZstdCompressor()
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def test_dictionary_and_frames():
    rng = random.Random(3)
    records = [warc.record(str(i), "u", " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=200)).encode(), None, False, "d") for i in range(300)]
    trained = zstandard.train_dictionary(4096, records)
    packer = zstandard.ZstdCompressor(dict_data=trained)
    body = b"".join(packer.compress(r) for r in records)
    for raw in (trained.as_bytes(), zstandard.ZstdCompressor().compress(trained.as_bytes())):
        data = struct.pack("<II", warc.SKIPPABLE_DICTIONARY, len(raw)) + raw + body
        assert list(warc.frames(io.BytesIO(data), "x")) == records
        middle = struct.pack("<II", 0x184D2A51, 3) + b"abc"
        assert list(warc.frames(io.BytesIO(data + middle + packer.compress(records[0])), "x")) == [*records, records[0]]
    with pytest.raises(ValueError, match="cannot be decoded"):
        list(warc.frames(io.BytesIO(body), "x"))
    for cut in (1, 3, len(data) - 5):
        with pytest.raises(ValueError):
            list(warc.frames(io.BytesIO(data[:cut]), "x"))
    with pytest.raises(ValueError, match="no frame"):
        list(warc.frames(io.BytesIO(b"plain text"), "x"))


def test_damaged_records_are_refused():
    good = warc.record("1", "http://a/", b"payload", None, False, "2024-01-01T00:00:00Z")
    assert warc.parsed(good, "x")["payload"] == b"payload"
    for bad, why in [
        (good.replace(b"WARC/1.1", b"WARC/9"), "no WARC record"), (good.replace(b"WARC-Date", b"X-Date"), "WARC-Date is missing"),
        (good[:-1], "Content-Length"), (good + b"x", "Content-Length"), (good.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"), "block digest"),
        (good.replace(b"WARC-Type: ", b"WARC-Type"), "bad header"),
    ]:
        with pytest.raises(ValueError, match=why):
            warc.parsed(bad, "x")


def test_url_edges(spark):
    urls = [
        "http://a.com", "http://a.com/", "HTTPS://WWW.Example.COM/en/x", "http://example.com/en/", "http://notexample.com/en/",
        "http://x.example.com/en", "http://b.net/es/", "http://b.net:80/es/", "http://com/", "no scheme", None, "", "http://a.org?x=/net/es/",
        "ftp://a://b.com/", "http://my-casino.org/", "http://casinos.org/", "http://cheap-pills.example.org", "http://a.org/casino/",
    ]
    rows = [(i, u, "own", "own") for i, u in enumerate(urls)] + [(1, urls[1], "own", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    out = url_rules.judged(df, queries.url_rule_list())
    assert out.count() == len(rows)
    got = {urls[r.page_id]: (r.host, r.path, r.rule if r.rule_tier == 2 else None, r.verdict) for r in out.collect()}
    assert got["http://a.com"] == ("a.com", "", None, "allow")
    assert got["http://a.com/"] == ("a.com", "/", "com/", "allow")
    assert got["HTTPS://WWW.Example.COM/en/x"] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got["http://example.com/en/"][2:] == ("example.com/en/", "block")
    assert got["http://notexample.com/en/"][2:] == got["http://x.example.com/en"][2:] == ("com/", "allow")
    assert got["http://b.net/es/"][2:] == ("net/es/", "block") and got["http://b.net:80/es/"][2:] == (None, "allow")
    assert got["http://com/"][2:] == ("com/", "allow")
    assert got["no scheme"] == got[None] == got[""] == ("", "", None, "allow")
    assert got["http://a.org?x=/net/es/"] == ("a.org", "", None, "allow")
    assert got["ftp://a://b.com/"][:2] == ("a:", "//b.com/")
    assert got["http://my-casino.org/"][3] == got["http://cheap-pills.example.org"][3] == "block"
    assert got["http://casinos.org/"][3] == got["http://a.org/casino/"][3] == "allow"
    assert url_rules.judged(df.limit(0), queries.url_rule_list()).count() == 0
    free = url_rules.judged(df, [url_rules.Rule("odd", "block", "org$", ())]).collect()
    assert {urls[r.page_id] for r in free if r.verdict == "block"} == {"http://a.org?x=/net/es/", "http://cheap-pills.example.org"}


def test_counts_equal_the_library(spark, sf_dir):
    library = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_token_counts(spark, sf_dir).collect()}
    for d, text in docs.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len(text.encode()), n > 1024)
    odd = [*fuzz(), "aab" * 3_000, " " * 5_000, "x" * 30_000, "\n" * 99 + "a  b", "a\nb c", " a", "a ", "<|endoftext|> x", "a <|endoftext|>"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(odd)] + [(None, None, None)], "doc_id long, text string, n int")
    rows = token_counts.counted(df).collect()
    assert len(rows) == len(odd) + 1
    for r in rows:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.counted(df.limit(0)).count() == 0


def test_side_by_side_merges_of_small_arrays(monkeypatch):
    own = token_counts.Counter(bpe.vocabulary_path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_counts, "SYMBOLS", 7)
    library = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    texts = ["hello there", "", None, "aaaaaa", "the the"]
    assert own.count(texts) == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert Path(bpe.vocabulary_path("byte_bpe_50k.json")).exists()
