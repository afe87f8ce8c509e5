"""Reading tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a DataFrame; columns and filters reach the Parquet scan."""
    if name not in NAMES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers tables as temporary views."""
    for name in names or NAMES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
