"""Parquet table access: one helper, so that every reader prunes columns the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def widened(df: DataFrame) -> DataFrame:
    """Spread rows when a scan has fewer tasks than the cluster has cores (one big row group),
    for work that is heavy per row. A scan with enough splits is left as it is: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
