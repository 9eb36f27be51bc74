"""Where the registered queries and their DuckDB counterparts are kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # The test tables hold zone-free times; SQL reads them as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_column(columns: list[str], template: str) -> str:
    """One SQL select per column, {c} and {i} filled in."""
    return "\nUNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(columns))
