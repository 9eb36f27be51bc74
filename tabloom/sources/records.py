"""CSV files with line breaks inside quotes, read by many tasks.

A file is cut into byte ranges as any text file is, and a range knows its lines but not whether its first line starts
a record or continues a quoted value. The number of quotes before it tells: a range is inside quotes exactly if the
ranges before it hold an odd number of them (a quote inside a quoted value is doubled, which changes nothing).

So one pass counts the quotes of every range, a running sum over the ranges of a file gives each its start, and a
second pass cuts records only at line breaks outside quotes. A record that runs over the end of a range leaves its
parts behind; they are few (two per range at most) and are put together afterwards. No task reads more than its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of records: a whole one; the first lines of one that goes on in the next range; lines of one that neither
#: starts nor ends here; the last lines of one that started in a range before.
WHOLE, TAIL, MIDDLE, HEAD = range(4)


def marked_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(file, block, line, quotes, inside, after): lines in file order within their byte range; whether the range
    starts inside quotes, and whether the next one does."""
    text = spark.read.option("lineSep", "\n").text(path)
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("line"),
        F.length(F.regexp_replace(value, '[^"]+', "")).alias("quotes"),
    )
    ranges = lines.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    # One row per byte range of a file.
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("odd").over(along), F.lit(0)) % 2
    known = ranges.select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), (before == 1).alias("inside"), ((before + F.col("odd")) % 2 == 1).alias("after")
    )
    same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    return lines.join(F.broadcast(known), same).drop("_file", "_block")


def _cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Records of each byte range: the whole ones, or the parts at its ends."""
    place, odd, held, kind, first = None, 0, [], WHOLE, True
    out: list[tuple] = []

    def close(ended: bool) -> None:
        """The held lines are a record or a part of one."""
        nonlocal first
        if not held:
            return
        name = (WHOLE if ended else TAIL) if kind == WHOLE else (HEAD if ended else MIDDLE)
        if (name == WHOLE) == whole:
            out.append((*place, name, first and place[1] == 0, "\n".join(held)))
        first = False

    def emitted() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(made, ["file", "block", "kind", "first", "value"])

    for batch in batches:
        files, blocks, lines = (batch.column(i).to_pylist() for i in range(3))
        quotes = batch.column(3).to_numpy()
        starts = batch.column(4).to_pylist()
        if len(files) == 0:
            continue
        edges = [i for i in range(len(files)) if i == 0 or blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
        for a, b in zip(edges, [*edges[1:], len(files)], strict=True):
            if (files[a], blocks[a]) != place:
                close(odd == 0)
                place, odd, held, first = (files[a], blocks[a]), int(starts[a]), [], True
                kind = MIDDLE if odd else WHOLE
            upto = np.cumsum(quotes[a:b]) + odd
            outside = ((upto - quotes[a:b]) % 2 == 0).tolist()
            for i, fresh in enumerate(outside):
                if fresh and (held or kind != WHOLE):
                    close(True)
                    held, kind = [], WHOLE
                held.append(lines[a + i])
            odd = int(upto[-1] % 2)
        yield emitted()
    if place is not None:
        close(odd == 0)
        yield emitted()


_PARTS = "file string, block bigint, kind int, first boolean, value string"


def records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, first, value): every record of the files as text; ``first`` marks the first record of a file."""
    lines = marked_lines(spark, path, encoding)
    wanted = ["file", "block", "line", "quotes", "inside"]
    whole = lines.select(*wanted).mapInArrow(lambda b: _cut(b, True), _PARTS).select("file", "first", "value")
    ends = lines.where("inside or after").select(*wanted).mapInArrow(lambda b: _cut(b, False), _PARTS)
    # A record over several ranges: its first lines, ranges it fills, its last lines. Two parts per range at most.
    order = Window.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = F.sort_array(F.collect_list(F.struct("block", "value")))
    joined = ends.withColumn("record", number).groupBy("file", "record").agg(
        F.max("first").alias("first"), F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value")
    )
    every = whole.unionByName(joined.select("file", "first", "value"))
    return every.where(F.trim(F.regexp_replace("value", "\r$", "")) != "")


def read_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A table of text columns named by the header of the first file; the first record of each file is a header.

    Where lines end in CR LF, a line break inside quotes is read as LF, as Spark's reader of whole files does.
    """
    rows = records(spark, path, encoding)
    # The header: one row.
    head = rows.where("first").orderBy("file").select("value").first()
    if head is None:
        return spark.createDataFrame([], "value string").drop("value")
    options = {"escape": '"', "maxCharsPerColumn": "-1"}
    plain = F.regexp_replace("value", "\r$", "")
    if head["value"].endswith("\r"):
        plain = F.regexp_replace(plain, "\r\n", "\n")
    first = head["value"].removesuffix("\r").lstrip("\ufeff")
    cells = spark.range(1).select(F.explode(_cells(first)).alias("c")).collect()
    names = [row["c"] for row in cells]
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    parsed = rows.where("not first").select(F.from_csv(plain, schema, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def _cells(line: str):
    """The cells of a header, parsed by Spark's own CSV reader as many columns as there can be."""
    width = line.count(",") + 1
    schema = ", ".join(f"`c{i}` string" for i in range(width))
    row = F.from_csv(F.lit(line), schema, {"escape": '"'})
    cells = F.array(*[row[f"c{i}"] for i in range(width)])
    return F.filter(cells, lambda c: c.isNotNull())
