"""Structured Streaming jobs: counters, injection audit, detection, enrichment.

Every transformation is a plain function that works on a batch and on a stream. Late data
beyond the watermark is dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workloom.operators import detectors, protection
from workloom.operators.enrich import with_cluster
from workloom.session import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table's Parquet files as a stream: those of its folder, or the one file of that name."""
    path = f"{folder}/{name}.parquet"
    there = spark.read.parquet(path)
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_per_trigger)
    if [f.rsplit("/", 1)[-1] for f in there.inputFiles()] == [f"{name}.parquet"]:
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


def closable(stream: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a second, empty source behind it, and a function that puts one row of the far
    future into that source. A finished input never moves the watermark past its last events; the
    closing row, sent in a run of its own, does. Its own key waits for ever and gives no output.
    """
    spark, schema = stream.sparkSession, stream.schema
    path = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)

    def close() -> None:
        row = spark.range(1).select(*[
            (F.lit("2200-01-01 00:00:00") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        row.write.mode("append").parquet(path)

    return stream.unionByName(spark.readStream.schema(schema).parquet(path)), close


def run_to_folder(df: DataFrame, mode: str = "append", shape: Callable[[DataFrame], DataFrame] | None = None,
                  close: Callable[[], None] | None = None) -> str:
    """Run a stream over the available input and return the folder it wrote; with ``close`` the run
    is followed by one over the closing row.

    Each micro-batch overwrites its own ``batch_id`` folder, so a batch that is repeated after
    a lost executor leaves the same rows.
    """
    base = f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        out = shape(batch) if shape else batch
        out.write.mode("overwrite").parquet(f"{base}/data/batch_id={batch_id}")

    for last in (False, True) if close else (False,):
        if last:
            close()
        query = (
            df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).foreachBatch(write).start()
        )
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    return f"{base}/data"


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last update per key of a stream written in update mode."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*keys, "batch_id")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def timed(df: DataFrame, column: str = "ts", lateness: str = "10 minutes") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def request_counters(events: DataFrame, cap: int = 60) -> DataFrame:
    """Requests per minute, share of the cap in percent, and what is left."""
    per = timed(events).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("requests"))
    return per.select(
        F.col("window.start").alias("window_start"), "requests",
        (F.col("requests") / cap * 100).alias("utilisation_percent"),
        F.greatest(F.lit(cap) - F.col("requests"), F.lit(0)).alias("remaining"),
    )


def cost_counters(events: DataFrame, cost: Column, cap: float = 10.0) -> DataFrame:
    """Cost per sliding hour, every five minutes."""
    per = timed(events).groupBy(F.window("ts", "1 hour", "5 minutes")).agg(F.sum(cost).alias("cost"))
    return per.select(
        F.col("window.start").alias("window_start"), "cost",
        (F.col("cost") / cap * 100).alias("utilisation_percent"),
        F.greatest(F.lit(cap) - F.col("cost"), F.lit(0.0)).alias("remaining"),
    )


def injection_audit(statements: DataFrame) -> DataFrame:
    """Audit entries of suspicious statements; stateless."""
    return protection.audit_entries(
        protection.sanitised_statements(statements), "start_time", "executed_by", "warehouse_id")


def deduplicated_audit(entries: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One entry per statement hash within the watermark."""
    return timed(entries, "event_time", lateness).dropDuplicatesWithinWatermark(["query_hash"])


def violation_counts(statements: DataFrame, keys=detectors.DEFAULT_RULES) -> DataFrame:
    """Findings per day and rule over finished statements; rules run on each row."""
    done = statements.filter(F.col("execution_status") == "FINISHED").withColumn(
        "start_time", F.col("start_time").cast("timestamp")).withWatermark("start_time", "1 hour")
    ready = done.select("start_time", "statement_text")
    for name, kind in (("partition_specs", "array<struct<table_name:string,columns:array<string>>>"),
                       ("unique_columns", "array<string>"), ("column_types", "array<struct<name:string,type:string>>")):
        ready = ready.withColumn(name, F.array().cast(kind))
    app = statements.sparkSession.sparkContext.applicationId

    def named(key: str) -> Column:
        return F.transform(detectors.findings_of(key, app), lambda v: F.lit(key))

    found = detectors.prepared(ready).select(
        "start_time", F.explode_outer(F.concat(*[named(k) for k in keys])).alias("rule_key")).filter(
        F.col("rule_key").isNotNull())
    return found.groupBy(F.window("start_time", "1 day"), "rule_key").agg(F.count("*").alias("violations")).select(
        F.col("window.start").alias("day"), "rule_key", "violations")


def security_counters(events: DataFrame) -> DataFrame:
    """Security events by type per hour."""
    kinds = ("detector_load", "prompt_injection_attempt", "detector_timeout", "resource_violation")
    return timed(events).groupBy(F.window("ts", "1 hour")).agg(
        F.count("*").alias("total"),
        *[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in kinds],
    ).select(F.col("window.start").alias("hour"), "total", *kinds)


def enriched_stream(statements: DataFrame, changes: DataFrame, node_types: DataFrame) -> str:
    """Cluster facts for each micro-batch of statements; the as-of join runs per batch."""
    return run_to_folder(statements, shape=lambda batch: with_cluster(batch, changes, node_types))
