import re

from pyspark.sql import functions as F

from tabloom.llm import pii

TEXTS = {
    1: "write to Ann.Lee@Corp.example.com or ann.lee@corp.example.com, also bob@corp.example.com.",
    2: "call +1 (017) 555-7713 now, +1-017-555-7713 later; not 12345 nor 2024-01-02",
    3: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end',
    4: "from 97.51.17.173 but 1.2.3 and 300.1.1.1 stay",
    5: "card 4845168114407329 and 4845 1681 1440 7329, not 9807915762804490, not 4845168114407328",
    6: "Mrs. Anna Smith met Mr. John Smith, then Mr. Smith; Госпожа Анна Петрова und Herr Müller",
    7: "nothing here: a@b, 12, plain words.",
    8: None,
    9: "",
    10: "ssn 123-45-6789 x",
    11: "a" * 200_000 + " q@r.example.org " + "9" * 50_000,
    12: "same q@r.example.org",
}


def test_kinds_formats_and_coreference(spark):
    rows = [(i, t, "k", "f") for i, t in TEXTS.items()] + [(12, TEXTS[12], "k", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_key string, text_units string")
    out = pii.replaced(df, count="n")
    assert out.columns == [*df.columns, "n"]
    found = out.collect()
    assert len(found) == len(rows)
    got = {r.doc_id: r.text for r in found}
    assert {i for i in TEXTS if got[i] == TEXTS[i]} == {7, 8, 9}
    one = re.findall(r"[\w.]+@\w+\.example\.com", got[1])
    assert len(one) == 3 and one[0] == one[1] != one[2] and "corp" not in got[1] and "bob" not in got[1]
    assert one[0].split("@")[1] == one[2].split("@")[1]
    phones = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) now, (\+1-\d{3}-\d{3}-\d{4}) later; not 12345 nor 2024-01-02", got[2])
    assert re.sub(r"\D", "", phones[1]) == re.sub(r"\D", "", phones[2]) != "10175557713"
    assert re.fullmatch(r'token = "[0-9a-f]{40}" end', got[3])
    assert re.fullmatch(r"from \d+\.\d+\.\d+\.\d+ but 1\.2\.3 and 300\.1\.1\.1 stay", got[4])
    cards = re.fullmatch(r"card (4\d{15}) and (4\d{3} \d{4} \d{4} \d{4}), not 9807915762804490, not 4845168114407328", got[5])
    assert cards[1] == cards[2].replace(" ", "")
    odd, even = cards[1][-1::-2], cards[1][-2::-2]
    assert (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)) % 10 == 0
    names = re.fullmatch(
        r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+), then Mr\. (\w+); Госпожа ([а-яА-Я]+) ([а-яА-Я]+) und Herr (\w+)", got[6]
    )
    assert names[2] == names[4] == names[5] and names[1].endswith("na") and names[6].endswith("на")
    assert re.fullmatch(r"ssn \d{3}-\d{2}-\d{4} x", got[10])
    assert got[11].startswith("a" * 200_000 + " ") and got[11].endswith(" " + "9" * 50_000)
    assert got[11].split()[1] == got[12].split()[1] and "q@r" not in got[12]
    assert out.filter("doc_id = 12").count() == 2
    again = {r.doc_id: r.text for r in pii.replaced(df).collect()}
    assert again == got
    assert {r.doc_id: r.text for r in pii.replaced(df, key="other").collect()}[3] != got[3]
    assert pii.replaced(df.limit(0)).count() == 0


def test_crowded_numbers_stay_distinct(spark):
    """900 of 1,000 possible mailboxes force many second draws."""
    df = spark.range(900).select("id", F.format_string("x %03d@a.example.com y", "id").alias("text"))
    out = {r.id: r.text for r in pii.replaced(df).collect()}
    assert len(set(out.values())) == 900
    assert not set(re.findall(r"\d{3}@a\.", " ".join(out.values())))


def test_query_replaces_all_and_only_personal_data(spark, sf_dir):
    from tabloom.llm.queries import op10_pii_surrogates

    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    after = {r.doc_id: (r.text, r.n_units) for r in op10_pii_surrogates(spark, sf_dir).collect()}
    assert set(after) == set(before)
    private = re.compile(r"\S+@\S+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b[0-9a-f]{40}\b")
    for d, text in before.items():
        for found in private.findall(text or ""):
            assert found not in after[d][0]
        if not re.search(r"@|\d", text or ""):
            assert after[d] == (text, 0)
