"""Metric, rating and cost columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from workloom.functions import metrics as m
from workloom.functions.formats import rounded, rounded_sql
from workloom.operators import enrich
from workloom.plans.history import H
from workloom.plans.joins import CLUSTER_SQL, NT, C, clustered
from workloom.plans.registry import query
from workloom.sources.workload import node_types, view

GIB = "1073741824.0::DOUBLE"

RATIOS_SQL = f"""SELECT *, CASE WHEN read_bytes <> 0 THEN shuffle_read_bytes / read_bytes::DOUBLE END AS shuffle_ratio,
 CASE WHEN read_bytes <> 0 THEN spilled_local_bytes / read_bytes::DOUBLE END AS spill_ratio,
 CASE WHEN read_rows <> 0 THEN produced_rows / read_rows::DOUBLE END AS selectivity_ratio, coalesce(spilled_local_bytes, 0) > 0 AS has_spill FROM {{src}}"""

RATE_SQL = "CASE node_type " + " ".join(
    f"WHEN '{n}' THEN {r}::DOUBLE" for n, r in m.DBU_RATES
) + " WHEN 'g4dn.xlarge' THEN CAST(regexp_extract(executor_memory, '^(\\d+)', 1) AS DOUBLE) * 0.25::DOUBLE ELSE 2.0::DOUBLE END"

PRICED_SQL = f"""SELECT *, hourly_cost * (execution_duration_ms / 3600000::DOUBLE) AS run_cost, hourly_cost * (execution_duration_ms / 3600000::DOUBLE) * 24 AS daily_cost
FROM (SELECT *, dbu_rate * 3.0::DOUBLE * (executor_count + 1) * 0.10::DOUBLE AS hourly_cost FROM (
 SELECT *, CASE WHEN node_type IS NOT NULL THEN {RATE_SQL} END AS dbu_rate,
 CASE WHEN node_type IS NULL THEN NULL WHEN node_type IN ('g4dn.xlarge', 'unknown') THEN 'estimated' ELSE 'accurate' END AS rate_method
 FROM ({RATIOS_SQL.format(src="(" + CLUSTER_SQL + ")")})))"""

PERF_SQL = """CASE WHEN shuffle_ratio > 1 THEN 'CRITICAL' WHEN execution_duration_ms / 1000.0 > 300 THEN 'CRITICAL'
 WHEN execution_duration_ms / 1000.0 > 60 THEN 'WARNING' ELSE 'NORMAL' END"""
NET_SQL = """CASE WHEN shuffle_ratio IS NULL THEN NULL WHEN shuffle_ratio > 1 THEN 'CRITICAL' WHEN shuffle_ratio > 0.5 THEN 'WARNING'
 WHEN shuffle_ratio = 0 THEN 'OPTIMAL' ELSE 'NORMAL' END"""
IO_SQL = f"CASE WHEN read_bytes / {GIB} > 100 THEN 'CRITICAL' WHEN read_bytes / {GIB} > 10 THEN 'WARNING' ELSE 'NORMAL' END"


def priced(spark, d):
    return enrich.with_cost(enrich.with_ratings(enrich.with_ratios(clustered(spark, d))))


def history(spark, d):
    return view(spark, d, "history")


@query("C1_slow_flag", f"SELECT statement_id, execution_duration_ms / 1000.0 > 60 AS is_slow FROM {H}")
def c1(spark, d):
    return history(spark, d).select("statement_id", m.is_slow(F.col("execution_duration_ms")).alias("is_slow"))


@query("C2_readable_units", f"""SELECT statement_id, CASE WHEN execution_duration_ms / 1000::DOUBLE < 60 THEN printf('%.1fs', execution_duration_ms / 1000::DOUBLE)
 ELSE printf('%.1fm', execution_duration_ms / 1000::DOUBLE / 60) END AS duration_text,
 CASE WHEN read_bytes / {GIB} < 1 THEN printf('%.1fMB', read_bytes / 1048576.0::DOUBLE) ELSE printf('%.2fGB', read_bytes / {GIB}) END AS data_text FROM {H}""")
def c2(spark, d):
    return history(spark, d).select(
        "statement_id", m.duration_text(F.col("execution_duration_ms")).alias("duration_text"),
        m.bytes_text(F.col("read_bytes")).alias("data_text"),
    )


@query("C3_ratios", f"SELECT statement_id, shuffle_ratio, spill_ratio, selectivity_ratio, has_spill FROM ({RATIOS_SQL.format(src=H)})")
def c3(spark, d):
    return enrich.with_ratios(history(spark, d)).select(
        "statement_id", "shuffle_ratio", "spill_ratio", "selectivity_ratio", "has_spill"
    )


MEMORY_TEXT = "CASE event_id % 7 WHEN 0 THEN '8GB' WHEN 1 THEN '16g' WHEN 2 THEN ' 8192m ' WHEN 3 THEN '8388608k' WHEN 4 THEN concat('', CAST(event_id AS VARCHAR(20))) WHEN 5 THEN '2.5 TB' ELSE 'much' END"


@query("C4_memory_whole_gb", f"""
SELECT statement_id, t AS memory_text, CASE WHEN n = '' THEN 0 WHEN u = 'g' THEN n::BIGINT WHEN u IN ('m', '') THEN n::BIGINT // 1024 ELSE n::BIGINT // 1048576 END AS gb_bare_is_mb,
 CASE WHEN n = '' THEN 0 WHEN u IN ('g', '') THEN n::BIGINT WHEN u = 'm' THEN n::BIGINT // 1024 ELSE n::BIGINT // 1048576 END AS gb_bare_is_gb
FROM (SELECT statement_id, t, regexp_extract(lower(trim(t)), '^(\\d+)', 1) AS n, regexp_extract(lower(trim(t)), '^\\d+([gmk])', 1) AS u
 FROM (SELECT statement_id, {MEMORY_TEXT} AS t FROM {H}))""")
def c4(spark, d):
    t = history(spark, d).select("statement_id", F.expr(MEMORY_TEXT).alias("memory_text"))
    return t.withColumns({
        "gb_bare_is_mb": m.memory_gb_whole(F.col("memory_text"), "m"),
        "gb_bare_is_gb": m.memory_gb_whole(F.col("memory_text"), "g"),
    })


@query("C5_memory_gb", f"""
SELECT statement_id, CASE u WHEN 'GB' THEN n::DOUBLE WHEN 'MB' THEN n::DOUBLE / 1024 WHEN 'TB' THEN n::DOUBLE * 1024 END AS memory_gb
FROM (SELECT statement_id, regexp_extract(upper(t), '^(\\d+\\.?\\d*)\\s*(GB|MB|TB)', 1) AS n, regexp_extract(upper(t), '^(\\d+\\.?\\d*)\\s*(GB|MB|TB)', 2) AS u
 FROM (SELECT statement_id, {MEMORY_TEXT} AS t FROM {H}))""")
def c5(spark, d):
    return history(spark, d).select("statement_id", m.memory_gb(F.expr(MEMORY_TEXT)).alias("memory_gb"))


@query("C6_performance_rating", f"SELECT statement_id, {PERF_SQL} AS performance FROM ({RATIOS_SQL.format(src=H)})")
def c6(spark, d):
    return enrich.with_ratings(enrich.with_ratios(history(spark, d))).select("statement_id", "performance")


@query("C7_network_rating", f"""SELECT statement_id, {NET_SQL} AS network, CASE WHEN shuffle_ratio IS NULL THEN NULL WHEN shuffle_ratio > 1 THEN printf('shuffle is %.1f%% of the scan', shuffle_ratio * 100)
 WHEN shuffle_ratio > 0.5 THEN 'high network traffic relative to the scan' WHEN shuffle_ratio = 0 THEN 'no shuffle, probably a broadcast join' ELSE 'usual shuffle volume' END AS evidence
FROM ({RATIOS_SQL.format(src=H)})""")
def c7(spark, d):
    return enrich.with_ratings(enrich.with_ratios(history(spark, d))).select(
        "statement_id", "network", m.network_evidence(F.col("shuffle_ratio")).alias("evidence")
    )


@query("C8_io_rating", f"SELECT statement_id, {IO_SQL} AS io FROM {H}")
def c8(spark, d):
    return enrich.with_ratings(enrich.with_ratios(history(spark, d))).select("statement_id", "io")


@query("C9_memory_rating", f"""
SELECT statement_id, CASE WHEN peak = 0 THEN NULL WHEN gb IS NULL THEN 'INFO' WHEN peak * 100.0 / (gb * 1024.0) > 90 THEN 'CRITICAL'
 WHEN peak * 100.0 / (gb * 1024.0) > 70 THEN 'WARNING' ELSE 'NORMAL' END AS memory
FROM (SELECT statement_id, event_id % 66000 AS peak, CAST(regexp_extract(executor_memory, '^(\\d+)', 1) AS BIGINT) AS gb FROM ({CLUSTER_SQL}))""")
def c9(spark, d):
    return clustered(spark, d).select(
        "statement_id",
        m.memory_rating(F.col("event_id") % 66000, m.memory_gb_whole(F.col("executor_memory"))).alias("memory"),
    )


@query("C11_dbu_rate", f"SELECT statement_id, node_type, dbu_rate, rate_method FROM ({PRICED_SQL})")
def c11(spark, d):
    return priced(spark, d).select("statement_id", "node_type", "dbu_rate", "rate_method")


@query("C12_run_cost", f"""SELECT statement_id, executor_count + 1 AS total_nodes, {rounded_sql("hourly_cost", 6)} AS hourly_cost, {rounded_sql("run_cost", 6)} AS run_cost,
 {rounded_sql("daily_cost", 6)} AS daily_cost FROM ({PRICED_SQL})""")
def c12(spark, d):
    return priced(spark, d).select(
        "statement_id", (F.col("executor_count") + 1).alias("total_nodes"),
        *[rounded(F.col(c), 6).alias(c) for c in ("hourly_cost", "run_cost", "daily_cost")],
    )


@query("C13_waste_cost", f"""
SELECT statement_id, baseline_ms, {rounded_sql("CASE WHEN execution_duration_ms <= baseline_ms THEN 0 ELSE daily_cost - hourly_cost * (baseline_ms / 3600000::DOUBLE) * 24 END", 6)} AS daily_waste,
 CASE WHEN execution_duration_ms <= baseline_ms THEN 'already at its best' ELSE printf('takes %.1fx longer than optimal (%.0fs vs %.0fs)',
  execution_duration_ms / baseline_ms::DOUBLE, execution_duration_ms / 1000::DOUBLE, baseline_ms / 1000::DOUBLE) END AS waste_note
FROM (SELECT p.*, b.baseline_ms FROM ({PRICED_SQL}) p JOIN (SELECT statement_text AS st, min(execution_duration_ms) AS baseline_ms FROM {H} GROUP BY 1) b ON p.statement_text = b.st)""")
def c13(spark, d):
    shape = F.sha2("statement_text", 256).alias("shape")
    base = priced(spark, d).select("*", shape)
    best = enrich.shape_baseline(history(spark, d).select(shape, "execution_duration_ms"), "shape")
    return enrich.with_waste(base.join(best, "shape")).select(
        "statement_id", "baseline_ms", rounded(F.col("daily_waste"), 6).alias("daily_waste"), "waste_note"
    )


CONFIG_INPUT = f"""SELECT statement_id AS config_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'i3.xlarge' WHEN 2 THEN 'x9.huge' ELSE 'r5.xlarge' END AS node_type,
 CASE WHEN event_id % 6 = 0 THEN 'm5.4xlarge' END AS worker_node_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS executor_count,
 CASE WHEN event_id % 7 < 3 THEN event_id % 7 END AS worker_count, CASE WHEN event_id % 8 = 0 THEN '61GB' END AS executor_memory,
 CASE WHEN event_id % 3 = 0 THEN 'm5.xlarge' END AS driver_node_type, CASE WHEN event_id % 9 = 0 THEN '4GB' END AS driver_memory FROM """


@query("C14_cluster_input", f"""
SELECT config_id, node, workers, coalesce(executor_memory, w.m) AS memory, coalesce(driver_memory, d.m) AS driver_memory,
 CASE WHEN node IS NULL THEN 'missing node type' WHEN workers IS NULL THEN 'missing worker count' WHEN coalesce(executor_memory, w.m) IS NULL THEN 'memory not resolved' END AS problem
FROM (SELECT *, coalesce(worker_node_type, node_type) AS node, coalesce(nullif(executor_count, 0), nullif(worker_count, 0)) AS workers FROM ({CONFIG_INPUT} {H}))
LEFT JOIN (SELECT node_type AS k, CAST(memory_mb // 1024 AS VARCHAR) || 'GB' AS m FROM {NT}) w ON node = w.k
LEFT JOIN (SELECT node_type AS k, CAST(memory_mb // 1024 AS VARCHAR) || 'GB' AS m FROM {NT}) d ON driver_node_type = d.k""")
def c14(spark, d):
    rows = spark.sql(CONFIG_INPUT + "{h}", h=history(spark, d))
    return enrich.normalise_cluster_input(rows, node_types(spark))


@query("A12_cost_rollup", f"""
SELECT CAST(CAST(start_time AS DATE) AS VARCHAR) AS day, executed_by, count(*) AS statements, {rounded_sql("sum(coalesce(run_cost, 0))", 4)} AS cost,
 max(CASE {PERF_SQL} WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 ELSE 1 END) AS worst_rating, GROUPING(CAST(start_time AS DATE)) * 2 + GROUPING(executed_by) AS level,
 {rounded_sql("sum(coalesce(run_cost, 0))", 4)} > 5 AS over_threshold
FROM ({PRICED_SQL}) GROUP BY ROLLUP (CAST(start_time AS DATE), executed_by)""")
def a12(spark, d):
    """Cost per day and user with totals, the worst rating, and a daily alert threshold."""
    worst = F.when(F.col("performance") == "CRITICAL", 3).when(F.col("performance") == "WARNING", 2).otherwise(1)
    return (
        priced(spark, d)
        .withColumn("day", F.to_date("start_time"))
        .rollup("day", "executed_by")
        .agg(
            F.count("*").alias("statements"),
            rounded(F.sum(F.coalesce("run_cost", F.lit(0.0))), 4).alias("cost"),
            F.max(worst).alias("worst_rating"),
            F.grouping_id().alias("level"),
        )
        .withColumn("day", F.col("day").cast("string"))
        .withColumn("over_threshold", F.col("cost") > 5)
    )
