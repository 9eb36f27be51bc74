"""Exact duplicates by a tree merge of sorted digest runs.

Every partition holds a run of entries (digest, verifying SHA-256, identifier to keep, rows). In binomial
rounds partitions whose numbers differ in one digit (of base ``RADIX``) exchange their runs: an entry moves
to the partition that has the same digit as the entry's digest there. The runs that arrive are merged in
order (digest, SHA-256, identifier), and entries that also agree in SHA-256 become one, with the preferred
identifier and the summed rows. After the last round all entries of a digest have met, and no partition ever
held more than its share of digests. A text with a third of all rows comes from every partition, so its rows
are spread over all receivers of the first round and have shrunk to one entry each after it.

Defined cases: null texts count as empty; a null identifier stays only where a text has no other; rows that
repeat text and identifier are one document listed twice and carry the same result (``survivors`` returns
one of them); an empty table gives an empty table; other columns pass through, except that columns already
named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import put_aside, ascii_lower, shield, stored

RADIX = 8
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _digit(number: Column, place: int) -> Column:
    return F.pmod(F.shiftright(number, 3 * place), F.lit(RADIX))


def _merge_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in order, preferred identifier first: those of one text become one entry."""
    held = None
    for batch in batches:
        done = []
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for slot, digest, sha, keep, rows, keep_rows in zip(*columns, strict=True):
            if held and held[1] == digest and held[2] == sha and held[0] == slot:
                held[4] += rows
                if held[3] == keep:
                    held[5] += keep_rows
            else:
                if held:
                    done.append(held)
                held = [slot, digest, sha, keep, rows, keep_rows]
        if done:
            yield _batch(done, batch.schema)
    if held:
        yield _batch([held], batch.schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, type=field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def tree_merge(entries: DataFrame, prefer: str = "smallest") -> DataFrame:
    """One row per text: sha, keep_id, rows, and keep_rows (rows that hold keep_id).

    ``entries`` has ``sha`` (binary SHA-256) and ``id``. ``prefer``: 'smallest' or 'largest' identifier stays.
    """
    width = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, math.ceil(math.log(max(width, 2), RADIX)))
    one = F.lit(1).cast("bigint")
    runs = entries.select(
        F.pmod(F.spark_partition_id(), F.lit(RADIX**rounds)).cast("bigint").alias("slot"),
        F.conv(F.substring(F.hex("sha"), 1, 14), 16, 10).cast("bigint").alias("digest"),
        "sha", F.col("id").alias("keep_id"), one.alias("rows"), one.alias("keep_rows"),
    )
    order = F.asc_nulls_last("keep_id") if prefer == "smallest" else F.desc_nulls_last("keep_id")
    for place in range(rounds):
        step = _digit(F.col("digest"), place) - _digit(F.col("slot"), place)
        sent = runs.withColumn("slot", (F.col("slot") + step * RADIX**place).cast("bigint"))
        arrived = sent.repartition("slot").sortWithinPartitions("slot", "digest", "sha", order)
        runs = arrived.mapInArrow(_merge_run, runs.schema)
    return runs.drop("slot", "digest")


def deduplicated(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", prefer: str = "smallest", carry: bool = True
) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256 (hex, of the normalised text).

    ``carry=False`` returns the identifier and the results alone and moves no text. Other columns called like a result
    or a helper come back as ``own_<name>``.
    """
    helpers = ("group_sha", "group_keep", "group_rows")
    rows = put_aside(df, (*RESULTS, *helpers), (id_col, text)) if carry else df.select(id_col, text)
    rows = rows.withColumn("text_sha256", F.sha2(normalised(F.col(text)), 256))
    if not carry:
        rows = stored(rows.drop(text), "digests")
    entries = rows.select(F.unhex("text_sha256").alias("sha"), F.col(id_col).alias("id"))
    merged = tree_merge(entries, prefer).filter("rows > 1")
    merged = merged.select(
        F.lower(F.hex("sha")).alias("group_sha"), F.col("keep_id").alias("group_keep"), F.col("rows").alias("group_rows")
    )
    joined = rows.join(merged, rows["text_sha256"] == merged["group_sha"], "left")
    alone = F.col("group_rows").isNull()
    keep = F.when(alone, rows[id_col]).otherwise(F.col("group_keep"))
    return joined.select(
        *[rows[c] for c in rows.columns], keep.alias("keep_id"),
        F.coalesce("group_rows", F.lit(1).cast("bigint")).alias("group_size"), rows[id_col].eqNullSafe(keep).alias("kept"),
    )


def survivors(df: DataFrame, id_col: str = "doc_id", text: str = "text", prefer: str = "smallest") -> DataFrame:
    """The rows that stay, one per text, with the columns of ``df``.

    Rows listed twice (same text and identifier) are rare; only texts that have such rows pay for a second step.
    """
    digest = "text_sha256"
    plain, back = shield(df, (digest, "group_sha", "group_keep", "group_twice"))
    rows = plain.withColumn(digest, F.sha2(normalised(F.col(text)), 256))
    small = stored(rows.select(F.unhex(digest).alias("sha"), F.col(id_col).alias("id")), "digests")
    merged = stored(tree_merge(small, prefer).filter("rows > 1"), "merged")
    merged = merged.select(F.lower(F.hex("sha")).alias("group_sha"), "keep_id", "keep_rows").withColumnsRenamed(
        {"keep_id": "group_keep", "keep_rows": "group_twice"}
    )
    joined = rows.join(merged, rows[digest] == merged["group_sha"], "left")
    joined = joined.filter(F.col("group_sha").isNull() | rows[id_col].eqNullSafe(F.col("group_keep")))
    columns = [rows[c] for c in plain.columns]
    if merged.filter("group_twice > 1").isEmpty():
        return joined.select(*columns).withColumnsRenamed(back)
    joined = stored(joined.select(*columns, digest, "group_twice"), "deduplicated")
    twice = F.coalesce("group_twice", F.lit(1)) > 1
    once = joined.filter(~twice).select(*plain.columns)
    one_each = joined.filter(twice).dropDuplicates([digest]).select(*plain.columns)
    return once.unionByName(one_each).withColumnsRenamed(back)
