"""Order-dependent work without one task holding a whole series.

Rows have no order in Spark, so every operator names its ``order_by`` columns, ending in a
unique key. A window over a whole series would pull the series into one task; a series may
hold a third of all rows. `Ordered` therefore checks the largest series first:

* within ``limit`` rows a plain window per series is used;
* beyond it the rows are numbered through a range partitioning on (series, order) and cut
  into blocks of ``block_rows``. Look-back windows get the last ``depth`` rows of the
  preceding block, and running results are carried over from a summary per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tabloom.functions.columns import col
from tabloom.session import shared_dir

WINDOW_LIMIT = 250_000
BLOCK_ROWS = 250_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest group; one aggregate with map-side combine."""
    sizes = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def number_rows(
    df: DataFrame, order_by: Sequence[str], name: str = "_rn", descending: bool = False, nulls_last: bool = False
) -> DataFrame:
    """Dense 1..n in the given order, whatever the size. Nulls come first unless ``nulls_last``.

    The range partitioning is fixed by a checkpoint, so the counts per partition and the
    numbered rows agree even when executors are lost. Select the needed columns before: a
    checkpoint keeps all of them.
    """
    spark = df.sparkSession
    shared_dir(spark)
    up = [col(c).asc_nulls_last() if nulls_last else col(c) for c in order_by]
    keys = [col(c).desc() for c in order_by] if descending else up
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn(
            "_pos",
            F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33),
        )
        .checkpoint()
    )
    # One count per range partition: bounded by the partition number.
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    offsets, seen = [], 0
    for row in counts:
        offsets.append((row["_part"], seen))
        seen += row["n"]
    if not offsets:
        return ranged.withColumn(name, F.lit(0).cast("bigint")).drop("_part", "_pos")
    starts = spark.createDataFrame(offsets, "_part int, _start bigint")
    return (
        ranged.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_pos") + F.col("_start") + 1)
        .drop("_part", "_pos", "_start")
    )


class Ordered:
    """A frame in a stated order, with look-back, fill and running-sum operations."""

    def __init__(
        self,
        df: DataFrame,
        order_by: Sequence[str],
        partition_by: Sequence[str] = (),
        limit: int = WINDOW_LIMIT,
        block_rows: int = BLOCK_ROWS,
        largest: int | None = None,
    ):
        self.partition_by = list(partition_by)
        self.order_by = list(order_by)
        if largest is None:
            largest = largest_group(df, self.partition_by)
        self.blocked = largest > limit
        self.block_rows = block_rows
        if self.blocked:
            numbered = number_rows(df, self.partition_by + self.order_by)
            self._set(numbered.withColumn("_block", F.floor((F.col("_rn") - 1) / block_rows).cast("bigint")))
        else:
            self._set(df)

    def _set(self, df: DataFrame) -> None:
        self.df = df

    def _groups(self) -> list[Column]:
        series = [col(c) for c in self.partition_by]
        return ([F.col("_block")] if self.blocked else []) + series

    def window(self, backward: bool = False) -> WindowSpec:
        order = [F.col("_rn")] if self.blocked else [col(c) for c in self.order_by]
        if backward:
            order = [c.desc() for c in order]
        groups = self._groups()
        return Window.partitionBy(*groups).orderBy(*order) if groups else Window.orderBy(*order)

    def look_back(self, depth: int, make: Callable[[WindowSpec], dict[str, Column]]) -> Ordered:
        """Add window expressions that read at most ``depth`` earlier rows."""
        if not self.blocked:
            self._set(self.df.withColumns(make(self.window())))
            return self
        if depth > self.block_rows:
            raise ValueError("depth exceeds the block size")
        place = (F.col("_rn") - 1) % self.block_rows
        own = F.col("_own")
        homes = F.when(place >= self.block_rows - depth, F.array(own, own + 1)).otherwise(F.array(own))
        spread = self.df.withColumnRenamed("_block", "_own").withColumn("_block", F.explode(homes))
        self._set(
            spread.withColumns(make(self.window()))
            .where(F.col("_block") == F.col("_own"))
            .drop("_own")
        )
        return self

    def fill(self, source: str, out: str, forward: bool = True) -> Ordered:
        """Nearest earlier (or later) non-null value of the same series.

        Looking ahead is looking back in reversed order: a frame that grows from the start is
        updated row by row, one that runs to the end would be summed up anew for each row.
        """
        value = col(source)
        grown = self.window(backward=not forward).rowsBetween(Window.unboundedPreceding, 0)
        local = F.last(value, ignorenulls=True).over(grown)
        if not self.blocked:
            self._set(self.df.withColumn(out, local))
            return self
        at = F.when(value.isNotNull(), F.col("_rn"))
        edge = F.max_by(value, at) if forward else F.min_by(value, at)
        edges = self.df.groupBy(*self._groups()).agg(edge.alias("_edge"))
        # One row per block and series: n / block_rows rows at most per series.
        place = F.col("_block") if forward else F.col("_block").desc()
        along = Window.partitionBy(*[col(c) for c in self.partition_by]).orderBy(place)
        carried = F.last("_edge", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        carry = edges.withColumn("_carry", carried).drop("_edge")
        joined = self._join_blocks(carry, ["_block", *self.partition_by])
        self._set(joined.withColumn(out, F.coalesce(local, F.col("_carry"))).drop("_carry"))
        return self

    def running_sum(self, source: str, out: str) -> Ordered:
        """Sum of ``source`` over the series up to and including the row."""
        local = F.sum(col(source)).over(self.window().rowsBetween(Window.unboundedPreceding, 0))
        if not self.blocked:
            self._set(self.df.withColumn(out, local))
            return self
        sums = self.df.groupBy(*self._groups()).agg(F.sum(col(source)).alias("_sum"))
        along = Window.partitionBy(*[col(c) for c in self.partition_by]).orderBy("_block")
        before = F.sum("_sum").over(along.rowsBetween(Window.unboundedPreceding, -1))
        carry = sums.withColumn("_carry", before).drop("_sum")
        joined = self._join_blocks(carry, ["_block", *self.partition_by])
        self._set(joined.withColumn(out, local + F.coalesce(F.col("_carry"), F.lit(0))).drop("_carry"))
        return self

    def _join_blocks(self, carry: DataFrame, keys: list[str]) -> DataFrame:
        renamed = carry.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_carry")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & col(k).eqNullSafe(F.col(f"_k{i}"))
        dropped = [f"_k{i}" for i in range(len(keys))]
        return self.df.join(renamed, same, "left").drop(*dropped)

    def with_columns(self, columns: dict[str, Column]) -> Ordered:
        self._set(self.df.withColumns(columns))
        return self

    def rows(self) -> DataFrame:
        """The frame without helper columns."""
        return self.df.drop("_rn", "_block")
