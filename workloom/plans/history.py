"""Sources and discovery over the history."""

from __future__ import annotations

from pyspark.sql import functions as F

from workloom.operators import discovery as ops
from workloom.plans.registry import query
from workloom.sources import workspace as ws
from workloom.sources.tables import TABLES, table
from workloom.sources.workload import node_types, node_types_sql, view, view_sql

AS_OF = "2024-01-31 00:00:00"
H = view_sql("history")


def raw_history(spark, d):
    """History in its nested source shape."""
    h = view(spark, d, "history")
    return h.withColumn("compute", F.struct("warehouse_id", "compute_id", "compute_type")).drop(
        "warehouse_id", "compute_id", "compute_type"
    )


def history(spark, d):
    return view(spark, d, "history")


@query("S1_query_history", f"""
SELECT statement_id, statement_text, coalesce(statement_type, 'UNKNOWN') AS statement_type, execution_status,
 error_message, executed_by, warehouse_id, compute_id, compute_type, start_time, end_time,
 coalesce(execution_duration_ms, 0) AS execution_duration_ms, coalesce(compilation_duration_ms, 0) AS compilation_duration_ms,
 coalesce(total_duration_ms, 0) AS total_duration_ms, coalesce(read_bytes, 0) AS read_bytes, coalesce(read_files, 0) AS read_files,
 coalesce(read_partitions, 0) AS read_partitions, coalesce(read_rows, 0) AS read_rows, coalesce(produced_rows, 0) AS produced_rows,
 coalesce(spilled_local_bytes, 0) AS spilled_local_bytes, shuffle_read_bytes, total_task_duration_ms,
 total_task_duration_ms * 0.00001::DOUBLE AS estimated_cost_usd FROM {H}""")
def s1(spark, d):
    return ws.query_history(raw_history(spark, d))


@query("S2_cluster_changes", f"SELECT * FROM {view_sql('clusters')}")
def s2(spark, d):
    raw = view(spark, d, "clusters").withColumn(
        "aws_attributes", F.struct(F.col("spot_availability").alias("availability"))
    )
    return ws.cluster_changes(raw)


@query("S3_node_specs_in_use", f"""
SELECT worker_node_type, count(*) AS versions, n.memory_gb, n.memory_text, n.core_count, n.gpu_count, n.category
FROM {view_sql('clusters')} c JOIN (SELECT node_type, CAST(floor(memory_mb / 1024) AS BIGINT) AS memory_gb,
 concat(CAST(CAST(floor(memory_mb / 1024) AS BIGINT) AS VARCHAR), 'GB') AS memory_text, coalesce(core_count, 0) AS core_count,
 coalesce(gpu_count, 0) AS gpu_count, coalesce(category, 'Unknown') AS category FROM {node_types_sql()}) n
ON c.worker_node_type = n.node_type GROUP BY ALL""")
def s3(spark, d):
    """Node specs of every cluster version: the look-up applied to the change log."""
    specs = ws.node_specs(node_types(spark))
    used = view(spark, d, "clusters").groupBy("worker_node_type").agg(F.count("*").alias("versions"))
    return used.join(specs, used.worker_node_type == specs.node_type).drop("node_type")


@query("S4_node_timeline", f"""
SELECT cluster_id, instance_id, start_time, end_time, mem_used_percent, mem_swap_percent,
 cpu_user_percent + cpu_system_percent AS cpu_percent, cpu_wait_percent, network_sent_bytes, network_received_bytes
FROM {view_sql('timeline')}""")
def s4(spark, d):
    return ws.node_timeline(view(spark, d, "timeline"))


@query("S5_catalog_columns", f"""
SELECT table_name, column_name, data_type, column_comment, is_nullable = 'YES' AS nullable, ordinal_position, table_comment
FROM {view_sql('columns')} WHERE len(string_split(table_name, '.')) = 3""")
def s5(spark, d):
    return ws.catalog_columns(view(spark, d, "columns"))


TAG_TEXT = """SELECT table_name, {extra} string_agg(tag_name || '=' || tag_value, ', ' ORDER BY tag_name) AS tag_text
FROM (SELECT table_name, {extra} tag_name, arg_max(tag_value, applied_seq) AS tag_value FROM {tags} WHERE {cond} GROUP BY ALL) GROUP BY ALL"""


def tag_text(df):
    joined = F.array_join(
        F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "
    )
    return df.withColumn("tag_text", joined).drop("tags")


@query("S6_table_tags", TAG_TEXT.format(extra="", tags=view_sql("tags"), cond="column_name IS NULL"))
def s6(spark, d):
    tags = view(spark, d, "tags").filter(F.col("column_name").isNull())
    return tag_text(ws.tag_maps(tags, "table_name"))


@query("S6_column_tags", TAG_TEXT.format(extra="column_name,", tags=view_sql("tags"), cond="column_name IS NOT NULL"))
def s6c(spark, d):
    tags = view(spark, d, "tags").filter(F.col("column_name").isNotNull())
    return tag_text(ws.tag_maps(tags, "table_name", "column_name"))


@query("S17_table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) > 0 AS has_rows FROM {t}" for t in TABLES))
def s17(spark, d):
    return ws.table_counts({t: table(spark, d, t) for t in TABLES})


@query("P1_statements_by_id", f"""
SELECT statement_id, executed_by, total_duration_ms FROM {H} h
WHERE statement_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_totalprice > 400000)""")
def p1(spark, d):
    wanted = table(spark, d, "orders").filter("o_totalprice > 400000").select(
        F.col("o_orderkey").cast("string").alias("statement_id")
    )
    return ops.by_ids(history(spark, d), wanted).select("statement_id", "executed_by", "total_duration_ms")


def since(hours):
    return f"start_time >= TIMESTAMP '{AS_OF}' - INTERVAL '{hours}' HOUR"


@query("P2_recent_statements", f"""
SELECT statement_id, start_time, execution_status FROM {H} WHERE {since(400)} AND executed_by = 'user7' AND execution_status = 'FINISHED'
ORDER BY start_time DESC, statement_id LIMIT 20""")
def p2(spark, d):
    return ops.recent(history(spark, d), AS_OF, "user7", hours=400, status="FINISHED").select(
        "statement_id", "start_time", "execution_status"
    )


@query("P3_slow_statements", f"""
SELECT statement_id, executed_by, total_duration_ms FROM {H} WHERE {since(720)} AND total_duration_ms >= 60000
AND execution_status = 'FINISHED' ORDER BY total_duration_ms DESC, statement_id LIMIT 20""")
def p3(spark, d):
    return ops.slow(history(spark, d), AS_OF, hours=720).select("statement_id", "executed_by", "total_duration_ms")


@query("P4_expensive_statements", f"""
SELECT statement_id, total_task_duration_ms FROM {H} WHERE {since(720)} AND total_task_duration_ms >= 0.5::DOUBLE / 0.00001::DOUBLE
AND execution_status = 'FINISHED' ORDER BY total_task_duration_ms DESC, statement_id LIMIT 20""")
def p4(spark, d):
    return ops.expensive(history(spark, d), AS_OF, hours=720, min_cost_usd=0.5).select(
        "statement_id", "total_task_duration_ms"
    )


@query("P5_text_search", f"""
SELECT statement_id, statement_text FROM {H} WHERE {since(168)} AND contains(lower(statement_text), 'o_orderstatus')
ORDER BY start_time DESC, statement_id LIMIT 20""")
def p5(spark, d):
    return ops.search_text(history(spark, d), AS_OF, "O_OrderStatus").select("statement_id", "statement_text")


@query("P6_listing", f"""
SELECT statement_id, p AS preview, dur AS duration, cost, CASE WHEN length(p) > 50 THEN substr(p, 1, 47) || '...' ELSE p END AS short_preview,
 concat_ws(' | ', statement_id, executed_by, dur, cost, substr(p, 1, 50) || '...') AS display
FROM (SELECT *, substr(statement_text, 1, 100) AS p, printf('%.1fs', total_duration_ms / 1000) AS dur,
 CASE WHEN total_task_duration_ms * 0.00001::DOUBLE > 0 THEN printf('$%.2f', total_task_duration_ms * 0.00001::DOUBLE) ELSE 'N/A' END AS cost FROM {H})""")
def p6(spark, d):
    return ops.listing(history(spark, d))


@query("P7_task_cost", f"SELECT statement_id, total_task_duration_ms * 0.00001::DOUBLE AS estimated_cost_usd FROM {H}")
def p7(spark, d):
    return history(spark, d).select(
        "statement_id", ws.task_cost(F.col("total_task_duration_ms")).alias("estimated_cost_usd")
    )


@query("P8_workspace_candidates", f"""
SELECT statement_id, executed_by, total_duration_ms FROM (SELECT * FROM {H} WHERE {since(720)} AND total_duration_ms >= 1000
 AND execution_status = 'FINISHED' ORDER BY total_duration_ms DESC, statement_id LIMIT 1000)
WHERE executed_by IN ('user1', 'user2', 'user3', 'user4', 'user5', 'user6', 'user7', 'user8') AND coalesce(total_task_duration_ms * 0.00001::DOUBLE, 0) >= 0.2""")
def p8(spark, d):
    return ops.workspace_candidates(
        history(spark, d), AS_OF, hours=720, min_duration_ms=1000,
        users=[f"user{i}" for i in range(1, 9)], min_cost_usd=0.2, limit=1000, limit_first=True,
    ).select("statement_id", "executed_by", "total_duration_ms")


@query("P9_finished_flag", f"""
SELECT statement_id, execution_status, execution_status = 'FINISHED' AS is_finished,
 CASE WHEN execution_status <> 'FINISHED' THEN 'statement status is ' || execution_status END AS status_note FROM {H}""")
def p9(spark, d):
    return ops.finished_flag(history(spark, d)).select("statement_id", "execution_status", "is_finished", "status_note")
