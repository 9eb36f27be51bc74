"""The log of training runs: an append-only Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "id string, created_at timestamp, modality string, model_name string, dataset_name string, target_column string,"
    " feature_count int, metrics map<string,string>, config map<string,string>, user_id string"
)


def run_rows(
    metrics: DataFrame, dataset: str, target: str, feature_count: int, config: dict[str, object] | None = None,
    modality: str = "tabular", user: str | None = None,
) -> DataFrame:
    """One log row per model of a metrics table; failed models are left out, only scalars kept."""
    scalar = [f.name for f in metrics.schema.fields if f.dataType.simpleString() in (
        "double", "float", "int", "bigint", "string", "boolean") and f.name not in ("model", "error")]
    pairs = [x for name in scalar for x in (F.lit(name), F.col(f"`{name}`").cast("string"))]
    known = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    settings = [F.lit(str(x)) for item in (config or {}).items() for x in item]
    rows = metrics.where(F.col("error").isNull()) if "error" in metrics.columns else metrics
    return rows.select(
        F.uuid().alias("id"),
        F.current_timestamp().alias("created_at"),
        F.lit(modality).alias("modality"),
        F.col("model").alias("model_name"),
        F.lit(dataset).alias("dataset_name"),
        F.lit(target).alias("target_column"),
        F.lit(feature_count).cast("int").alias("feature_count"),
        known.alias("metrics"),
        (F.create_map(*settings) if settings else F.create_map().cast("map<string,string>")).alias("config"),
        F.lit(user).cast("string").alias("user_id"),
    )


def append_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def list_runs(spark: SparkSession, path: str, user: str | None = None, run_id: str | None = None) -> DataFrame:
    """Runs newest first, of one user or with one id; both tests reach the Parquet scan."""
    runs = spark.read.schema(RUN_SCHEMA).parquet(path)
    if user is not None:
        runs = runs.where(F.col("user_id") == user)
    if run_id is not None:
        runs = runs.where(F.col("id") == run_id)
    return runs.orderBy(F.desc("created_at"), "id")
