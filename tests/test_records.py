"""CSV records over many byte ranges against the reading by one task."""

import csv
import random

import pytest

from tabloom.sources import files
from tabloom.sources import records as R

VALUES = [
    "x", "a,b", 'say "hi"', "line\nbreak", "two\n\nbreaks\n", "cr\r\nlf", "", "é\nü", "long " + "w " * 300 + "\n end", '"', '\n"\n', "\n" * 40,
]


def write(path, rows, header=("id", "no te", "a,b"), encoding="utf-8", end="\r\n", seed=1):
    rng = random.Random(seed)
    with open(path, "w", newline="", encoding=encoding) as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(header)
        for i in rows:
            out.writerow([i, rng.choice(VALUES), rng.choice(VALUES)])


def one_task(spark, path, encoding="UTF-8"):
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.option("encoding", encoding).csv(path)


def same(a, b):
    by_id = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
    return a.columns == b.columns and by_id(a) == by_id(b)


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (size, "1"), strict=True)]
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", ["61", "700", "5000", "64m"])
@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_one_file_over_many_tasks(spark, tmp_path, small_ranges, size, end):
    path = str(tmp_path / "big.csv")
    write(path, range(150 if size == "61" else 900), end=end)
    small_ranges(size)
    assert R.marked_lines(spark, path, "UTF-8").select("block").distinct().count() > (60 if size == "61" else 7)
    assert same(R.read_records(spark, path), one_task(spark, path))


def test_several_files_and_another_encoding(spark, tmp_path, small_ranges):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(4):
        write(folder / f"part{i}.csv", range(100 * i, 100 * i + 100), encoding="latin-1", seed=i)
    small_ranges("900")
    assert same(R.read_records(spark, str(folder), "ISO-8859-1"), one_task(spark, str(folder), "ISO-8859-1"))
    read = files.read_csv(spark, str(folder), multiline=True)
    assert dict(read.dtypes)["id"] == "bigint" and read.count() == 400


def test_odd_files(spark, tmp_path, small_ranges):
    small_ranges("20")
    path = tmp_path / "head.csv"
    path.write_text('"a\nb",c\n1,2\n\n3,"4\n\n5"')
    found = R.read_records(spark, str(path))
    assert found.columns == ["a\nb", "c"] and sorted(map(tuple, found.collect())) == [("1", "2"), ("3", "4\n\n5")]
    empty = tmp_path / "empty.csv"
    empty.write_text("a,b\n")
    assert R.read_records(spark, str(empty)).columns == ["a", "b"] and R.read_records(spark, str(empty)).count() == 0
    none = tmp_path / "none.csv"
    none.write_text("")
    assert R.read_records(spark, str(none)).count() == 0
