"""Intermediate tables and files of the operators live in the folder the cluster shares."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from workloom.session import shared_folder
from workloom.sources.files import file_system, task_count  # noqa: F401


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lost executors cost only the read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch between executors and their Python workers.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def _number(setting: str | None) -> float:
    """A row count or a size in bytes as Spark's settings write it; infinite where there is no limit."""
    found = re.fullmatch(r"(\d+)([kmgt]?)b?", (setting or "").strip().lower())
    return (int(found[1]) << 10 * " kmgt".index(found[2] or " ")) or math.inf if found else math.inf


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH: executors and workers each keep several copies of a batch
    outside the heap. Smaller settings stay."""
    for key, most in BATCH.items():
        if _number(spark.conf.get(key, None)) > most:
            spark.conf.set(key, str(most))
