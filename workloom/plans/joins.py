"""Temporal, dimension and derivation joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from workloom.functions.formats import rounded, rounded_sql
from workloom.operators import enrich
from workloom.operators import temporal_joins as tj
from workloom.operators import time_index
from workloom.plans.history import H
from workloom.plans.registry import query
from workloom.sources.tables import table
from workloom.sources.workload import node_types, node_types_sql, view, view_sql

C = view_sql("clusters")
T = view_sql("timeline")
NT = node_types_sql()

AS_OF_SQL = f"""
SELECT h.*, v.cluster_id, v.cluster_name, v.worker_node_type, v.driver_node_type, v.worker_count, v.min_autoscale_workers,
 v.max_autoscale_workers, v.spot_availability, v.change_time
FROM {H} h LEFT JOIN (
 SELECT * FROM (SELECT h.statement_id AS sid, c.*, row_number() OVER (PARTITION BY h.statement_id ORDER BY c.change_time DESC, c.worker_node_type DESC) AS rn
  FROM {H} h JOIN {C} c ON h.compute_id = c.cluster_id AND c.change_time <= date_trunc('second', h.start_time)
   AND (c.delete_time IS NULL OR c.delete_time > date_trunc('second', h.start_time))) WHERE rn = 1) v ON h.statement_id = v.sid"""

CLUSTER_SQL = f"""
SELECT a.*, CASE WHEN cluster_id IS NOT NULL THEN coalesce(worker_node_type, 'unknown') END AS node_type,
 CASE WHEN cluster_id IS NOT NULL THEN coalesce(nullif(coalesce(worker_count, CASE WHEN min_autoscale_workers <> 0 THEN max_autoscale_workers END), 0), 1) END AS executor_count,
 CASE WHEN cluster_id IS NOT NULL THEN CAST(CAST(floor(coalesce(w.memory_mb, 8192) / 1024) AS BIGINT) AS VARCHAR) || 'GB' END AS executor_memory,
 CASE WHEN cluster_id IS NOT NULL THEN CAST(CAST(floor(coalesce(d.memory_mb, w.memory_mb, 8192) / 1024) AS BIGINT) AS VARCHAR) || 'GB' END AS driver_memory,
 CASE WHEN cluster_id IS NOT NULL THEN contains(upper(spot_availability), 'SPOT') END AS spot_instance
FROM ({AS_OF_SQL}) a LEFT JOIN {NT} w ON a.worker_node_type = w.node_type LEFT JOIN {NT} d ON a.driver_node_type = d.node_type"""

PAIRS_SQL = f"""
SELECT h.statement_id, t.instance_id, t.start_time AS sample_start, t.* EXCLUDE (instance_id, start_time) FROM {H} h JOIN {T} t ON h.compute_id = t.cluster_id
 AND t.start_time >= date_trunc('second', h.start_time)
 AND t.end_time <= date_trunc('second', h.start_time + h.total_duration_ms * INTERVAL '1' MILLISECOND) WHERE h.total_duration_ms > 0"""


def clustered(spark, d):
    return enrich.with_cluster(view(spark, d, "history"), view(spark, d, "clusters"), node_types(spark))


@query("J1_cluster_as_of", f"""SELECT statement_id, cluster_id, change_time, worker_node_type, driver_node_type, worker_count,
 max_autoscale_workers, spot_availability FROM ({AS_OF_SQL})""")
def j1(spark, d):
    return tj.cluster_as_of(view(spark, d, "history"), view(spark, d, "clusters")).select(
        "statement_id", "cluster_id", "change_time", "worker_node_type", "driver_node_type", "worker_count",
        "max_autoscale_workers", "spot_availability",
    )


@query("J2_latest_cluster", f"""
SELECT h.statement_id, c.cluster_id, c.change_time, c.worker_node_type, c.worker_count FROM {H} h LEFT JOIN
 (SELECT * FROM {C} QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY change_time DESC, worker_node_type DESC) = 1) c ON h.compute_id = c.cluster_id""")
def j2(spark, d):
    return tj.latest_cluster(view(spark, d, "history"), view(spark, d, "clusters")).select(
        "statement_id", "cluster_id", "change_time", "worker_node_type", "worker_count"
    )


@query("J3_node_spec_join", f"""
SELECT c.cluster_id, c.change_time, c.worker_node_type, c.driver_node_type, w.memory_mb AS worker_memory_mb, w.core_count AS worker_core_count,
 w.gpu_count AS worker_gpu_count, d.memory_mb AS driver_memory_mb FROM {C} c LEFT JOIN {NT} w ON c.worker_node_type = w.node_type
 LEFT JOIN {NT} d ON c.driver_node_type = d.node_type""")
def j3(spark, d):
    return tj.add_node_specs(view(spark, d, "clusters"), node_types(spark)).select(
        "cluster_id", "change_time", "worker_node_type", "driver_node_type", "worker_memory_mb",
        "worker_core_count", "worker_gpu_count", "driver_memory_mb",
    )


@query("J4_cluster_derivation", f"""SELECT statement_id, cluster_id, node_type, executor_count, executor_memory, driver_memory, spot_instance FROM ({CLUSTER_SQL})""")
def j4(spark, d):
    return clustered(spark, d).select(
        "statement_id", "cluster_id", "node_type", "executor_count", "executor_memory", "driver_memory", "spot_instance"
    )


@query("J5_samples_in_run", f"SELECT statement_id, instance_id, epoch(sample_start)::BIGINT AS sample_s, mem_used_percent FROM ({PAIRS_SQL})")
def j5(spark, d):
    return tj.samples_in_run(view(spark, d, "history"), view(spark, d, "timeline")).select(
        "statement_id", "instance_id", F.unix_seconds("start_time").alias("sample_s"), "mem_used_percent"
    )


USAGE_SQL = f"""SELECT statement_id, max(mem_used_percent) AS peak_memory_percent, avg(mem_used_percent) AS avg_memory_percent,
 coalesce(max(mem_swap_percent), 0) > 0 AS memory_swap_detected, max(cpu_user_percent + cpu_system_percent) AS peak_cpu_percent,
 avg(cpu_user_percent + cpu_system_percent) AS avg_cpu_percent, avg(cpu_wait_percent) AS avg_io_wait_percent,
 CAST(sum(network_sent_bytes) AS BIGINT) AS total_network_sent, CAST(sum(network_received_bytes) AS BIGINT) AS total_network_received,
 count(DISTINCT instance_id) AS node_count, count(*) AS sample_count FROM ({PAIRS_SQL}) GROUP BY statement_id"""


@query("A1_runtime_utilisation", f"""SELECT statement_id, peak_memory_percent, {rounded_sql("avg_memory_percent", 6)} AS avg_memory_percent, memory_swap_detected,
 peak_cpu_percent, {rounded_sql("avg_cpu_percent", 6)} AS avg_cpu_percent, {rounded_sql("avg_io_wait_percent", 6)} AS avg_io_wait_percent,
 total_network_sent, total_network_received, node_count, sample_count FROM ({USAGE_SQL})""")
def a1(spark, d):
    usage = time_index.utilisation(view(spark, d, "history"), view(spark, d, "timeline"))
    return usage.withColumns({
        c: rounded(F.col(c), 6) for c in ("avg_memory_percent", "avg_cpu_percent", "avg_io_wait_percent")
    })
