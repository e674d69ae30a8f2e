"""The workspace analysis end to end, one registered query per output."""

from __future__ import annotations

from pyspark.sql import functions as F

from workloom.functions.formats import rounded, rounded_sql
from workloom.operators import detectors as det
from workloom.operators.ranking import latest_per_key
from workloom.operators.workspace_report import analyze_workspace
from workloom.plans.detection import CONFIG, expected_sql
from workloom.plans.history import AS_OF, H, history, since
from workloom.plans.joins import USAGE_SQL
from workloom.plans.metrics import PERF_SQL, PRICED_SQL
from workloom.plans.registry import query
from workloom.sources.tables import table
from workloom.sources.workload import node_types, view

CHOSEN = f"(SELECT * FROM {H} WHERE {since(720)} AND total_duration_ms >= 1000 AND execution_status = 'FINISHED')"
SET = f"""(SELECT * FROM ({CONFIG.format(customer='customer')}) QUALIFY row_number() OVER (PARTITION BY rule_key ORDER BY c_custkey DESC) = 1)"""
FOUND = f"""(SELECT v.* FROM ({expected_sql(det.DEFAULT_RULES)}) v JOIN {CHOSEN} s ON v.statement_id = s.statement_id
 LEFT JOIN {SET} c ON v.rule_key = c.rule_key WHERE coalesce(c.enabled, TRUE))"""
COUNTED = f"""(SELECT s.*, total_task_duration_ms * 0.00001::DOUBLE AS cost_usd, coalesce(v.n, 0) AS violation_count FROM {CHOSEN} s
 LEFT JOIN (SELECT statement_id, count(*) AS n FROM {FOUND} GROUP BY 1) v ON s.statement_id = v.statement_id)"""


def report(spark, d):
    config = latest_per_key(spark.sql(CONFIG, customer=table(spark, d, "customer")), ["rule_key"], F.col("c_custkey"))
    return analyze_workspace(
        history(spark, d), view(spark, d, "clusters"), node_types(spark), view(spark, d, "timeline"), AS_OF,
        rules=config.withColumn("confidence", F.col("confidence").cast("double")), hours=720, min_duration_ms=1000)


@query("A2_workspace_report_totals", f"""SELECT count(*) AS total_statements, count(*) FILTER (violation_count > 0) AS statements_with_violations,
 CAST(sum(violation_count) AS BIGINT) AS total_violations, {rounded_sql("sum(coalesce(cost_usd, 0))", 4)} AS total_cost_usd,
 {rounded_sql("count(*) FILTER (violation_count > 0) / greatest(count(*), 1)::DOUBLE * 100", 6)} AS violation_rate FROM {COUNTED}""")
def totals(spark, d):
    return report(spark, d)["totals"].withColumns({
        "total_cost_usd": rounded(F.col("total_cost_usd"), 4), "violation_rate": rounded(F.col("violation_rate"), 6)})


@query("A3_workspace_report_rules", f"SELECT rule_key, count(*) AS violations FROM {FOUND} GROUP BY 1")
def by_rule(spark, d):
    return report(spark, d)["by_rule"]


@query("A4_workspace_report_users", f"SELECT executed_by, CAST(sum(violation_count) AS BIGINT) AS violations FROM {COUNTED} GROUP BY 1")
def by_user(spark, d):
    return report(spark, d)["by_user"]


@query("W2_workspace_report_worst", f"""SELECT s.statement_id, s.violation_count, {rounded_sql("s.cost_usd", 6)} AS cost_usd, p.cluster_id, p.performance,
 {rounded_sql("p.run_cost", 6)} AS run_cost, u.peak_memory_percent
 FROM (SELECT * FROM {COUNTED} ORDER BY violation_count DESC, coalesce(cost_usd, 0) DESC, total_duration_ms DESC, statement_id LIMIT 50) s
 LEFT JOIN (SELECT *, {PERF_SQL} AS performance FROM ({PRICED_SQL})) p ON s.statement_id = p.statement_id
 LEFT JOIN ({USAGE_SQL}) u ON s.statement_id = u.statement_id""")
def worst(spark, d):
    return report(spark, d)["worst"].select(
        "statement_id", "violation_count", rounded(F.col("cost_usd"), 6).alias("cost_usd"), "cluster_id", "performance",
        rounded(F.col("run_cost"), 6).alias("run_cost"), "peak_memory_percent")
