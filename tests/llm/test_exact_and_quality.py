import brute
import pytest
from compare import connect, differences

from tabloom.llm import exact_dedup, host_quality, queries


@pytest.mark.parametrize("name,sql", [("op6_exact_dedup", queries.EXACT_SQL), ("op8_quality_rules", queries.QUALITY_SQL)])
def test_equals_sql(spark, sf_dir, name, sql):
    assert differences(getattr(queries, name)(spark, sf_dir), connect(sf_dir), sql) == []


ROWS = [
    (1, "Same text", "x"), (2, "same TEXT", "y"), (3, "sÄme", "z"), (4, "säme", "z"), (None, "same text", None),
    (5, None, "n"), (6, "", "m"), (7, "lone", "l"), (7, "lone", "l"), (8, "long " * 100_000, "v"), (None, "null only", "q"),
]


@pytest.mark.parametrize("prefer,kept", [("smallest", {1, 3, 4, 5, 7, 8, None}), ("largest", {2, 3, 4, 6, 7, 8, None})])
def test_exact_edges(spark, prefer, kept):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, text_sha256 string").repartition(5)
    found = exact_dedup.survivors(df, prefer=prefer)
    assert found.columns == df.columns
    rows = found.collect()
    assert {r.doc_id for r in rows} == kept and len(rows) == 7
    assert exact_dedup.survivors(df.limit(0)).count() == 0
    marked = exact_dedup.deduplicated(df.drop("text_sha256"), prefer=prefer).collect()
    assert len(marked) == len(ROWS)
    assert {r.group_size for r in marked if brute.lower(r.text) == "same text"} == {3}


def test_quality_edges(spark):
    phrase = "a b c d e f g h"
    texts = [None, "", " \n\t", phrase, f"{phrase} {phrase}", "z " * 30, f"{phrase} i j {phrase} k l {phrase}", "q\nq\n\n q\nq", "# $ %"]
    rows = [(i, t, None if i % 2 else "s", "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, quality string")
    got = host_quality.measured(df.drop("quality")).collect()
    assert {r.doc_id: r.quality.n_repeat_words for r in got} == {i: brute.repeat_words(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.quality.n_dup_lines for r in got}[7] == 2
    assert host_quality.survivors(df).columns == df.columns
    assert host_quality.survivors(df.limit(0)).count() == 0


def test_bad_hosts_go_whole(spark):
    good = " ".join(f"word{i}" for i in range(30))
    rows = [(h * 100 + i, good if h != 3 or i == 0 else "short", f"h{h}") for h in range(8) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in host_quality.survivors(df).collect()}
    assert kept == {h * 100 + i for h in range(8) for i in range(40) if h != 3}


def test_host_rates_tighten_limits(spark):
    """Hosts of 10, 30, 60 and 90 % failures; every host has documents at all distances from the limits."""
    def text(i):
        return " ".join(f"w{j}{'#' if j < i * 13 % 30 else ''}" for j in range(60))

    rows = [(1000 * h + i, "short" if i % 100 < share else text(i), f"h{h}") for h, share in enumerate((10, 30, 60, 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    kept = {r.doc_id for r in host_quality.survivors(df).collect()}
    assert kept == brute.quality_kept(rows)
    plain = {d for d, t, _ in rows if t != "short" and t.count("#") <= 0.5 * len(t.split())}
    by_host = [sum(d // 1000 == h for d in plain - kept) / max(1, sum(d // 1000 == h for d in plain)) for h in range(4)]
    assert by_host[0] == by_host[1] == 0 < by_host[2] <= by_host[3] == 1


def test_own_rules_decide(spark):
    junk = " ".join(f"w{i}###" for i in range(60))
    fine = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, junk, "a"), (2, fine, "a"), (3, fine + " x", "b")], "doc_id long, text string, source string")
    assert {r.doc_id for r in host_quality.survivors(df).collect()} == {2, 3}


def test_host_step_decides_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = host_quality.Rules()
    judged = host_quality.judged_measured(host_quality.measured(docs, "text", rules).drop("text"), "source", rules)
    by_host = judged.where("NOT kept AND NOT quality.failed").count()
    assert {r.doc_id for r in judged.where("kept").select("doc_id").collect()} == brute.quality_kept(
        [(r.doc_id, r.text, r.source) for r in docs.collect()]
    )
    assert 0 <= by_host < 10
