"""Sources: tables written in another format, read back and compared with the originals."""

from pyspark.sql import functions as F

from tabloom.catalog.registry import query, table
from tabloom.session import scratch_path
from tabloom.sources import files

READ_SQL = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


def written(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.withColumns(
        {
            "o_orderstatus": F.when(F.col("o_orderkey") % 11 == 0, "N/A").otherwise(F.col("o_orderstatus")),
            "o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string")),
            "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        }
    )


@query("csv_source", READ_SQL)
def csv_source(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    written(spark, sf_dir).write.option("header", True).csv(path)
    return files.read_csv(spark, path)


@query("csv_source_latin1", READ_SQL.replace("o_orderpriority FROM", "'é' || o_orderpriority AS o_orderpriority FROM"))
def csv_source_latin1(spark, sf_dir):
    path = scratch_path(spark, "orders-latin1")
    rows = written(spark, sf_dir).withColumn("o_orderpriority", F.concat(F.lit("é"), F.col("o_orderpriority")))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_csv(spark, path)


@query("csv_source_utf16", READ_SQL)
def csv_source_utf16(spark, sf_dir):
    """One file per part of the table: UTF-16 files cannot be split."""
    path = scratch_path(spark, "orders-utf16")
    rows = written(spark, sf_dir).repartition(8)
    rows.write.option("header", True).option("encoding", "UTF-16").csv(path)
    return files.read_csv(spark, path)


@query(
    "csv_source_line_breaks",
    "SELECT o_orderkey, o_orderstatus || chr(10) || o_orderpriority AS note FROM orders",
)
def csv_source_line_breaks(spark, sf_dir):
    """Quoted line breaks; every file is read by as many tasks as its size asks for."""
    path = scratch_path(spark, "orders-lines")
    note = F.concat("o_orderstatus", F.lit("\n"), "o_orderpriority")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note")).repartition(8)
    rows.write.option("header", True).csv(path)
    return files.read_csv(spark, path, multiline=True)


@query("json_source", READ_SQL)
def json_source(spark, sf_dir):
    path = scratch_path(spark, "orders-json")
    o = table(spark, sf_dir, "orders")
    rows = o.withColumns(
        {
            "o_orderstatus": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus")),
            "o_totalprice": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")),
            "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        }
    )
    rows.write.json(path)
    return files.read_json(spark, path)


@query(
    "preview_rows",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
      o_orderpriority FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 8""",
)
def preview_rows(spark, sf_dir):
    return files.preview(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"])
