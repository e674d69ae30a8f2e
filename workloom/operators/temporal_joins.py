"""Joins along time: the cluster version valid at a start, and samples inside a run.

Neither side is grouped whole by cluster. Time is cut into buckets that become part of the
equi-join key, so a cluster that owns a third of the history is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONFIG = (
    "worker_node_type", "cluster_name", "driver_node_type", "worker_count",
    "min_autoscale_workers", "max_autoscale_workers", "spot_availability",
)
#: Days of a bucket: joins along time are keyed by (cluster, bucket).
BUCKET_DAYS = 32


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_date(F.to_date(at)) / BUCKET_DAYS)


def _versions(changes: DataFrame) -> DataFrame:
    """One row per version; the struct orders by change time, then by the configuration."""
    return changes.select(
        "cluster_id", "change_time", "delete_time",
        F.struct("change_time", *CONFIG).alias("version"),
    )


def version_segments(changes: DataFrame) -> DataFrame:
    """Disjoint spans (cluster_id, version, valid_from, valid_to) with the version that wins in each.

    The log of a cluster is cut at every change and delete. Versions that last are carried on by a
    running maximum; those with an end meet the cuts inside their life by (cluster, bucket).
    """
    versions = _versions(changes)
    lasting = versions.filter(F.col("delete_time").isNull()).select(
        "cluster_id", F.col("change_time").alias("at"), "version")
    ended = versions.filter(F.col("delete_time") > F.col("change_time"))
    none = F.lit(None).cast(versions.schema["version"].dataType).alias("version")
    cuts = (
        lasting.unionByName(ended.select("cluster_id", F.col("change_time").alias("at"), none))
        .unionByName(ended.select("cluster_id", F.col("delete_time").alias("at"), none))
        .groupBy("cluster_id", "at").agg(F.max("version").alias("version"))
    )
    by_time = W.partitionBy("cluster_id").orderBy("at")
    so_far = by_time.rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = cuts.select(
        "cluster_id", "at", F.max("version").over(so_far).alias("lasting"), F.lead("at").over(by_time).alias("valid_to"))
    lives = ended.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("change_time")), _bucket(F.col("delete_time")))))
    alive = (
        marked.select("cluster_id", "at", _bucket(F.col("at")).alias("bucket")).join(lives, ["cluster_id", "bucket"])
        .filter((F.col("at") >= F.col("change_time")) & (F.col("at") < F.col("delete_time")))
        .groupBy("cluster_id", "at").agg(F.max("version").alias("ended"))
    )
    return marked.join(alive, ["cluster_id", "at"], "left").select(
        "cluster_id", F.greatest("lasting", "ended").alias("version"), F.col("at").alias("valid_from"), "valid_to",
    ).filter(F.col("version").isNotNull())


def cluster_as_of(history: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest version with change_time <= start that is not deleted at the start.

    Starts are cut to seconds. The history is read and joined once, on (cluster, bucket of days);
    starts after today share today's bucket, up to which open spans reach. Statements without a
    cluster are spread by their id, since they match nothing.
    """
    today = _bucket(F.current_date())
    at = F.date_trunc("second", F.col("start_time").cast("timestamp")).cast("timestamp_ntz")
    keyed = history.withColumns({
        "_at": at,
        "_bucket": F.when(F.col("compute_id").isNull(), F.xxhash64("statement_id")).otherwise(
            F.least(_bucket(F.col("start_time")), today)),
    })
    first, last = _bucket(F.col("valid_from")), F.coalesce(F.least(_bucket(F.col("valid_to")), today), today)
    spans = version_segments(changes).select(
        "cluster_id", "version", "valid_from", "valid_to",
        F.explode(F.sequence(F.least(first, today), F.greatest(last, F.least(first, today)))).alias("bucket"))
    inside = (
        (F.col("s.compute_id") == F.col("v.cluster_id")) & (F.col("s._bucket") == F.col("v.bucket"))
        & (F.col("s._at") >= F.col("v.valid_from"))
        & (F.col("v.valid_to").isNull() | (F.col("s._at") < F.col("v.valid_to")))
    )
    return keyed.alias("s").join(spans.alias("v"), inside, "left").select(
        *[F.col(f"s.{c}") for c in history.columns],
        F.when(F.col("v.version").isNotNull(), F.col("s.compute_id")).alias("cluster_id"),
        F.col("v.version.change_time").alias("change_time"),
        *[F.col(f"v.version.{c}").alias(c) for c in CONFIG],
    )


def latest_cluster(history: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest version of each cluster, whatever the start."""
    newest = (
        _versions(changes).groupBy("cluster_id").agg(F.max("version").alias("version"))
        .select("cluster_id", F.col("version.change_time").alias("change_time"),
                *[F.col(f"version.{c}").alias(c) for c in CONFIG])
    )
    return history.join(newest, history["compute_id"] == newest["cluster_id"], "left")


def add_node_specs(versions: DataFrame, node_types: DataFrame) -> DataFrame:
    """Left joins on the worker and the driver node type. Spark broadcasts the node types
    when their known size is below its threshold and shuffles otherwise."""
    worker = node_types.select(
        F.col("node_type").alias("worker_node_type"), F.col("memory_mb").alias("worker_memory_mb"),
        F.col("core_count").alias("worker_core_count"), F.col("gpu_count").alias("worker_gpu_count"),
    )
    driver = node_types.select(
        F.col("node_type").alias("driver_node_type"), F.col("memory_mb").alias("driver_memory_mb")
    )
    return versions.join(worker, "worker_node_type", "left").join(driver, "driver_node_type", "left")


def derive_cluster(joined: DataFrame) -> DataFrame:
    """Node type, worker count, memory texts and the spot flag of the joined cluster."""
    worker_mb = F.when(F.col("worker_memory_mb") != 0, F.col("worker_memory_mb")).otherwise(F.lit(8192))
    driver_mb = F.when(F.col("driver_memory_mb") != 0, F.col("driver_memory_mb")).otherwise(worker_mb)
    auto = F.when(F.col("min_autoscale_workers") != 0, F.col("max_autoscale_workers"))
    count = F.coalesce(F.col("worker_count"), auto)
    known = F.col("cluster_id").isNotNull()

    def gb_text(mb: Column) -> Column:
        return F.concat(F.floor(mb / 1024).cast("string"), F.lit("GB"))

    derived = {
        "node_type": F.coalesce("worker_node_type", F.lit("unknown")),
        "executor_count": F.when(count != 0, count).otherwise(F.lit(1)),
        "executor_memory": gb_text(worker_mb),
        "driver_memory": gb_text(driver_mb),
        "spot_instance": F.when(
            F.col("spot_availability") != "", F.contains(F.upper("spot_availability"), F.lit("SPOT"))
        ),
    }
    return joined.withColumns({k: F.when(known, v) for k, v in derived.items()})


def samples_in_run(history: DataFrame, timeline: DataFrame) -> DataFrame:
    """(statement, sample) pairs: samples of the statement's cluster inside its run.

    Both sides are keyed by (cluster, minute). A run is repeated once per minute it touches,
    which is the number of sample intervals it can contain.
    """
    start = F.date_trunc("second", F.col("start_time").cast("timestamp"))
    end = F.date_trunc("second", F.timestamp_add(
        "MILLISECOND", F.col("total_duration_ms"), F.col("start_time").cast("timestamp")
    ))
    runs = (
        history.filter(
            F.col("compute_id").isNotNull() & F.col("start_time").isNotNull() & (F.col("total_duration_ms") > 0)
        )
        .select("statement_id", F.col("compute_id").alias("cluster_id"),
                start.alias("run_start"), end.alias("run_end"))
        .withColumn("minute", F.explode(F.sequence(
            F.floor(F.unix_seconds("run_start") / 60), F.floor(F.unix_seconds("run_end") / 60)
        )))
    )
    samples = timeline.withColumns({
        "start_time": F.col("start_time").cast("timestamp"),
        "end_time": F.col("end_time").cast("timestamp"),
    }).withColumn("minute", F.floor(F.unix_seconds("start_time") / 60))
    return runs.join(samples, ["cluster_id", "minute"]).filter(
        (F.col("start_time") >= F.col("run_start")) & (F.col("end_time") <= F.col("run_end"))
    )


def utilisation(pairs: DataFrame) -> DataFrame:
    """Memory, CPU, wait and network figures per statement with at least one sample."""
    cpu = F.col("cpu_user_percent") + F.col("cpu_system_percent")
    return pairs.groupBy("statement_id").agg(
        F.max("mem_used_percent").alias("peak_memory_percent"),
        F.avg("mem_used_percent").alias("avg_memory_percent"),
        (F.coalesce(F.max("mem_swap_percent"), F.lit(0.0)) > 0).alias("memory_swap_detected"),
        F.max(cpu).alias("peak_cpu_percent"),
        F.avg(cpu).alias("avg_cpu_percent"),
        F.avg("cpu_wait_percent").alias("avg_io_wait_percent"),
        F.sum("network_sent_bytes").alias("total_network_sent"),
        F.sum("network_received_bytes").alias("total_network_received"),
        F.count_distinct("instance_id").alias("node_count"),
        F.count("*").alias("sample_count"),
    )
