"""Scans of the workspace tables: history, clusters, node types, timeline, catalog, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workloom.functions.metrics import TASK_MS_USD
from workloom.sources.files import listed_files


def query_history(raw: DataFrame) -> DataFrame:
    """Flat history: nested compute opened, null counters to 0, unknown type named."""
    zero = [
        "execution_duration_ms", "compilation_duration_ms", "total_duration_ms", "read_bytes",
        "read_files", "read_partitions", "read_rows", "produced_rows", "spilled_local_bytes",
    ]
    return raw.select(
        "statement_id", "statement_text",
        F.coalesce("statement_type", F.lit("UNKNOWN")).alias("statement_type"),
        "execution_status", "error_message", "executed_by",
        F.col("compute.warehouse_id").alias("warehouse_id"),
        F.col("compute.compute_id").alias("compute_id"),
        F.col("compute.compute_type").alias("compute_type"),
        "start_time", "end_time",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in zero],
        "shuffle_read_bytes", "total_task_duration_ms",
        task_cost(F.col("total_task_duration_ms")).alias("estimated_cost_usd"),
    )


def task_cost(task_ms: Column) -> Column:
    return task_ms * TASK_MS_USD


def cluster_changes(raw: DataFrame) -> DataFrame:
    """Cluster versions with the nested availability opened."""
    return raw.select(
        "cluster_id", "cluster_name", "worker_node_type", "driver_node_type", "worker_count",
        "min_autoscale_workers", "max_autoscale_workers",
        F.col("aws_attributes.availability").alias("spot_availability"),
        "change_time", "delete_time",
    )


def node_specs(node_types: DataFrame) -> DataFrame:
    """Node types with whole GB, a text form, and null counts and category filled."""
    return node_types.select(
        "node_type",
        F.floor(F.col("memory_mb") / 1024).alias("memory_gb"),
        F.concat(F.floor(F.col("memory_mb") / 1024).cast("string"), F.lit("GB")).alias("memory_text"),
        F.coalesce("core_count", F.lit(0)).alias("core_count"),
        F.coalesce("gpu_count", F.lit(0)).alias("gpu_count"),
        F.coalesce("category", F.lit("Unknown")).alias("category"),
    )


def node_timeline(raw: DataFrame) -> DataFrame:
    return raw.select(
        "cluster_id", "instance_id", "start_time", "end_time",
        "mem_used_percent", "mem_swap_percent",
        (F.col("cpu_user_percent") + F.col("cpu_system_percent")).alias("cpu_percent"),
        "cpu_wait_percent", "network_sent_bytes", "network_received_bytes",
    )


def catalog_columns(columns: DataFrame) -> DataFrame:
    """Column metadata of tables with a three-part name."""
    return columns.filter(F.size(F.split("table_name", r"\.")) == 3).select(
        "table_name", "column_name", "data_type", "column_comment",
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.col("ordinal_position"), "table_comment",
    )


def latest_tags(tags: DataFrame, *keys: str) -> DataFrame:
    """One row per key and tag name, the last applied value wins."""
    return tags.groupBy(*keys, "tag_name").agg(F.max_by("tag_value", "applied_seq").alias("tag_value"))


def tag_maps(tags: DataFrame, *keys: str) -> DataFrame:
    """One map of tag name to value per key; only the latest values are collected."""
    return latest_tags(tags, *keys).groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag_name", "tag_value")))).alias("tags")
    )


def sql_files(spark: SparkSession, folder: str, pattern: str = "*.sql") -> DataFrame:
    """Each ``.sql`` file below a folder as one statement."""
    return listed_files(spark, folder, pattern).select(
        F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), F.col("content").cast("string").alias("statement_text"))


MOST_BYTES = 10 * 1024 * 1024


def guideline_files(
    spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = True, max_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Markdown files below a folder. Files over the size limit are not read; ``skipped_files`` has them."""
    files = listed_files(spark, folder, pattern, recursive, max_bytes).filter(F.col("length") <= max_bytes)
    return files.select("path", F.decode("content", "UTF-8").alias("markdown"))


def skipped_files(
    spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = True, max_bytes: int = MOST_BYTES,
) -> DataFrame:
    """(path, bytes, reason) of the files that ``guideline_files`` leaves out, found by their length alone."""
    files = listed_files(spark, folder, pattern, recursive, max_bytes=-1).filter(F.col("length") > max_bytes)
    return files.select("path", F.col("length").alias("bytes"), F.format_string("larger than %d bytes", F.lit(max_bytes)).alias("reason"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and existence per table, as one job."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", (F.col("row_count") > 0).alias("has_rows")
        )
        out = row if out is None else out.unionByName(row)
    return out
