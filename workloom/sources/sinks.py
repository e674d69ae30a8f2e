"""Sinks: date-partitioned tables, audit table, JSON lines, rule and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workloom.sources.files import write_keyed


def write_by_date(df: DataFrame, path: str, time_column: str, date_column: str, mode: str = "overwrite") -> None:
    """Write Parquet partitioned by the day of a time column.

    Rows are brought together by day and split by bytes (rebalance), so a day that holds most rows
    is written by several tasks and each task keeps few files open.
    """
    day = F.to_date(F.col(time_column)).alias(date_column)
    df.select("*", day).hint("rebalance", date_column).write.mode(mode).partitionBy(date_column).parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit entries, partitioned by event date."""
    write_by_date(df, path, "event_time", "event_date", mode="append")


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append JSON lines; times keep their microseconds, which the default format drops."""
    times = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    df.write.mode("append").option("timestampNTZFormat", times).option("timestampFormat", f"{times}XXX").json(path)


def write_files(df: DataFrame, path: str, key: str, text: str) -> None:
    """One file per key, with its text and a line end, below a folder named after the key. Null texts have
    no file; keys are dealt over a fixed number of tasks, however few bytes they are."""
    write_keyed(df, path, key, text)


def ensure_rules_table(spark: SparkSession, name: str) -> None:
    """Create the versioned rules table when it is missing."""
    spark.sql(f"""
        CREATE TABLE IF NOT EXISTS {name} (
          rule_id STRING, name STRING, category STRING, severity STRING, detection_method STRING,
          detector_class STRING, enabled BOOLEAN, explanation STRING, dependencies ARRAY<STRING>,
          custom_thresholds STRING, custom_message STRING, metadata STRING, config_version STRING,
          is_active BOOLEAN, created_by STRING, updated_by STRING, created_at TIMESTAMP, updated_at TIMESTAMP
        ) USING parquet
    """)


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("is_active"))
