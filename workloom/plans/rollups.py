"""Roll-ups, worst statements, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from workloom.functions.formats import rounded, rounded_sql
from workloom.operators import detectors as det
from workloom.operators import enrich, reports, rollups
from workloom.plans.detection import EXPECTED, expected_sql, history, values_sql, violations
from workloom.plans.history import H
from workloom.plans.joins import CLUSTER_SQL, clustered
from workloom.plans.metrics import PRICED_SQL, priced
from workloom.plans.registry import query
from workloom.sources.workload import view, view_sql
from workloom.sources.workspace import task_cost

DEFAULT = expected_sql(det.DEFAULT_RULES)
COST = "total_task_duration_ms * 0.00001::DOUBLE"
COUNTED = f"""(SELECT h.*, {COST} AS cost_usd, coalesce(v.n, 0) AS violation_count FROM {H} h LEFT JOIN
 (SELECT statement_id, count(*) AS n FROM ({DEFAULT}) GROUP BY 1) v ON h.statement_id = v.statement_id)"""


def statements(spark, d):
    return history(spark, d).withColumn("cost_usd", task_cost(F.col("total_task_duration_ms")))


@query("A2_workspace_totals", f"""SELECT count(*) AS total_statements, count(*) FILTER (violation_count > 0) AS statements_with_violations,
 CAST(sum(violation_count) AS BIGINT) AS total_violations, {rounded_sql("sum(coalesce(cost_usd, 0))", 4)} AS total_cost_usd,
 {rounded_sql("count(*) FILTER (violation_count > 0) / count(*)::DOUBLE * 100", 6)} AS violation_rate FROM {COUNTED}""")
def a2(spark, d):
    out = rollups.totals(statements(spark, d), violations(spark, d))
    return out.withColumns({"total_cost_usd": rounded(F.col("total_cost_usd"), 4), "violation_rate": rounded(F.col("violation_rate"), 6)})


@query("A3_violations_by_rule", f"SELECT rule_key, count(*) AS violations FROM ({DEFAULT}) GROUP BY 1")
def a3(spark, d):
    return rollups.by_rule(violations(spark, d))


@query("A4_violations_by_user", f"SELECT executed_by, CAST(sum(violation_count) AS BIGINT) AS violations FROM {COUNTED} GROUP BY 1")
def a4(spark, d):
    return rollups.by_user(history(spark, d), violations(spark, d))


MULTI = ["UNION_NO_ALL", "SELECT_STAR", "CARTESIAN_JOIN"]


@query("A5_violations_per_statement", f"""SELECT h.statement_id, count(e.rule_key) AS violation_count, coalesce(string_agg(e.rule_key || ':' || e.severity, ', ' ORDER BY e.rule_key, e.detail), '') AS found
 FROM {H} h LEFT JOIN ({expected_sql(MULTI)}) e ON h.statement_id = e.statement_id GROUP BY 1""")
def a5(spark, d):
    h = history(spark, d)
    out = det.with_statements(h, det.detect_statements(h, MULTI))
    found = F.array_join(F.transform("violations", lambda v: F.concat(v["rule_key"], F.lit(":"), v["severity"])), ", ")
    return out.select("statement_id", "violation_count", F.coalesce(found, F.lit("")).alias("found"))


SEVEN = ["UNION_NO_ALL", *det.DEFAULT_RULES]


@query("A6_overall_severity", f"""SELECT statement_id, CASE max(CASE rule_key WHEN 'CARTESIAN_JOIN' THEN 4 WHEN 'SELECT_STAR' THEN 3 ELSE 2 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' ELSE 'medium' END AS overall_severity,
 0.5::DOUBLE AS confidence FROM ({expected_sql(SEVEN)}) GROUP BY 1""")
def a6(spark, d):
    return rollups.overall_severity(violations(spark, d, SEVEN))


SEC = view_sql("security_events")


@query("A7_security_stats", f"""SELECT count(*) AS total_events, count(*) FILTER (event_type = 'detector_load') AS detector_loads,
 count(*) FILTER (event_type = 'prompt_injection_attempt') AS prompt_injections, count(*) FILTER (event_type = 'detector_timeout') AS timeouts,
 count(*) FILTER (event_type = 'resource_violation') AS resource_violations,
 count(*) FILTER (event_type = 'detector_load' AND risk_level IN ('high', 'critical')) AS high_risk_loads FROM {SEC}""")
def a7(spark, d):
    return rollups.security_stats(view(spark, d, "security_events"))


@query("A8_entries_per_minute", "SELECT date_trunc('minute', ts) AS minute, count(*) AS entries FROM events GROUP BY 1")
def a8(spark, d):
    from workloom.sources.tables import table

    out = rollups.entries_per_minute(table(spark, d, "events"), "ts")
    return out.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("A14_confidence_level", f"""SELECT c.statement_id, CASE WHEN c.read_files IS NOT NULL AND c.cluster_id IS NOT NULL AND coalesce(v.n, 0) > 1 THEN 'FULL' WHEN c.cluster_id IS NOT NULL THEN 'CLUSTER_ONLY'
 WHEN c.read_files IS NOT NULL THEN 'METRICS_ONLY' ELSE 'MINIMAL' END AS context_level FROM ({CLUSTER_SQL}) c LEFT JOIN (SELECT statement_id, count(*) AS n FROM ({expected_sql(MULTI)}) GROUP BY 1) v ON c.statement_id = v.statement_id""")
def a14(spark, d):
    """Metrics count as known when the file counter was reported."""
    found = rollups.per_statement(det.detect_statements(history(spark, d), MULTI))
    return clustered(spark, d).join(found, "statement_id", "left").select(
        "statement_id",
        rollups.confidence_level(
            F.col("read_files").isNotNull(), F.col("cluster_id").isNotNull(), F.coalesce("violation_count", F.lit(0)),
        ).alias("context_level"),
    )


@query("W2_worst_statements", f"""SELECT statement_id, violation_count, {rounded_sql("cost_usd", 6)} AS cost_usd FROM {COUNTED}
 ORDER BY violation_count DESC, coalesce({COST}, 0) DESC, total_duration_ms DESC, statement_id LIMIT 50""")
def w2(spark, d):
    return rollups.worst_statements(statements(spark, d), violations(spark, d)).select(
        "statement_id", "violation_count", rounded(F.col("cost_usd"), 6).alias("cost_usd"))


# Expected message and fix per template for the default rules.
TEXTS = (
    (0, "SPARK_001", "NON_SARGABLE", "high", "Filter wraps o_orderdate in YEAR(): no pruning on that column", "Use a half-open range: o_orderdate >= start AND o_orderdate < end"),
    (23, "SPARK_001", "NON_SARGABLE", "high", "Filter computes on o_totalprice: no pruning on that column", "Leave o_totalprice alone and divide the literal instead"),
    (1, "SPARK_002", "SELECT_STAR", "high", "All columns of lineitem are read", "Name the columns you need from lineitem"),
    (2, "SPARK_002", "SELECT_STAR", "medium", "All columns of orders are read", "Name the columns you need from orders"),
    (3, "SPARK_004", "CARTESIAN_JOIN", "critical", "Every row of orders meets every row of customer", "Join on a key: JOIN customer ON orders.key = customer.key"),
    (4, "SPARK_004", "CARTESIAN_JOIN", "critical", "Every row of nation, region, supplier meets every other row", "Write each table as a JOIN with its ON condition"),
    (5, "SPARK_004", "CARTESIAN_JOIN", "critical", "The join of orders and customer has no condition", "Join on a key: JOIN customer ON orders.key = customer.key"),
)
REPORTED = f"""(SELECT h.*, {COST} AS cost_usd, e.rule_id, e.rule_key, e.severity, e.message, e.fix FROM {H} h LEFT JOIN {values_sql(TEXTS)} e(template_id, rule_id, rule_key, severity, message, fix) ON h.template_id = e.template_id)"""


def reported(spark, d):
    s = statements(spark, d)
    return det.with_statements(s, det.detect_statements(s, det.DEFAULT_RULES))


@query("S12_json_report", f"""SELECT statement_id, concat('{{"query_id":"', statement_id, '","analysis_type":"post_execution","violation_count":', CASE WHEN rule_id IS NULL THEN '0' ELSE concat('1,"violations":[{{"rule_id":"', rule_id, '","rule_key":"', rule_key,
 '","severity":"', severity, '","message":"', message, '","fix_suggestion":"', fix, '"}}]') END, ',"execution_metrics":{{"duration_ms":', execution_duration_ms, ',"bytes_scanned":', read_bytes, ',"rows_scanned":', produced_rows,
 ',"read_rows":', read_rows, ',"spilled_bytes":', spilled_local_bytes, CASE WHEN shuffle_read_bytes IS NULL THEN '' ELSE concat(',"shuffle_read_bytes":', shuffle_read_bytes) END, '}}}}') AS report FROM {REPORTED}""")
def s12(spark, d):
    return reports.json_report(reported(spark, d))


GB = "printf('%.2fGB', read_bytes / 1073741824.0::DOUBLE)"
SECONDS = "printf('%.1fs', execution_duration_ms / 1000::DOUBLE)"


@query("S13_markdown_report", f"""SELECT statement_id, CASE WHEN rule_id IS NULL THEN concat('# Statement analysis', chr(10), chr(10), '**Query ID:** `', statement_id, '`', chr(10), chr(10), 'No violations found')
 ELSE concat('# Statement analysis', chr(10), chr(10), '**Query ID:** `', statement_id, '`', chr(10), '**Violations:** 1', chr(10), chr(10), '## Execution metrics', chr(10), chr(10), '- **Duration:** ', {SECONDS}, chr(10),
 '- **Data scanned:** ', {GB}, chr(10), CASE WHEN cost_usd > 0 THEN concat('- **Cost:** $', printf('%.2f', cost_usd), chr(10)) ELSE '' END, chr(10), '## Violations', chr(10), chr(10), '### 1. ', rule_id, ' (', severity, ')', chr(10), chr(10), message, chr(10), chr(10), '**Fix:** ', fix, chr(10), '---', chr(10)) END AS report FROM {REPORTED}""")
def s13(spark, d):
    return reports.markdown_report(reported(spark, d))


@query("S14_text_summary", f"""SELECT statement_id, CASE WHEN rule_id IS NULL THEN concat('No violations found (Query ID: ', statement_id, ')', chr(10), '  Duration: ', {SECONDS}, c)
 ELSE concat_ws(chr(10), repeat('=', 70), concat('Query ID: ', statement_id), concat('Duration: ', {SECONDS}, ' | Data Scanned: ', {GB}, c), repeat('=', 70),
 concat(chr(10), '1. ', rule_id, ' [', upper(severity), ']', chr(10), '   ', message, chr(10), '   Fix: ', fix), repeat('-', 70), 'Total: 1 violation(s)', repeat('=', 70)) END AS report
 FROM (SELECT *, CASE WHEN cost_usd > 0 THEN concat(' | Cost: $', printf('%.2f', cost_usd)) ELSE '' END AS c FROM {REPORTED})""")
def s14(spark, d):
    return reports.text_summary(reported(spark, d))


@query("S14_workspace_summary", f"""WITH c AS {COUNTED}, t AS (SELECT count(*) AS n, count(*) FILTER (violation_count > 0) AS w, CAST(sum(violation_count) AS BIGINT) AS v, sum(coalesce(cost_usd, 0)) AS cost FROM c),
 r AS (SELECT string_agg(concat('  ', rule_key, ': ', format('{{:,}}', n)), chr(10) ORDER BY n DESC, rule_key) AS txt FROM (SELECT rule_key, count(*) AS n FROM ({DEFAULT}) GROUP BY 1)),
 q AS (SELECT string_agg(concat('  ', rn, '. Query ', statement_id, ' | ', violation_count, ' violations | Cost: ', CASE WHEN cost_usd > 0 THEN printf('$%.2f', cost_usd) ELSE 'N/A' END, ' | Duration: ', printf('%.1fs', total_duration_ms / 1000::DOUBLE)), chr(10) ORDER BY rn) AS txt
  FROM (SELECT *, row_number() OVER (ORDER BY violation_count DESC, coalesce(cost_usd, 0) DESC, total_duration_ms DESC, statement_id) AS rn FROM c QUALIFY rn <= 10))
SELECT concat_ws(chr(10), 'Overview:', concat('  Total Queries Analyzed: ', format('{{:,}}', n)), concat('  Queries with Violations: ', format('{{:,}}', w), ' (', printf('%.1f', w / n::DOUBLE * 100), '%)'),
 concat('  Total Violations: ', format('{{:,}}', v)), concat('  Total Cost: $', format('{{:,.2f}}', cost)), 'Top Violation Types:', r.txt, 'Worst Performers:', q.txt) AS summary FROM t, r, q""")
def s14w(spark, d):
    s, v = statements(spark, d), violations(spark, d)
    return reports.workspace_summary(rollups.totals(s, v), rollups.by_rule(v), rollups.worst_statements(s, v, 10))


SHUFFLE = """CASE WHEN shuffle_ratio IS NULL THEN NULL WHEN shuffle_ratio > 1 THEN printf('- Shuffle: %.2fGB (%.0f%%{of} - CARTESIAN JOIN LIKELY)', gb, shuffle_ratio * 100)
 WHEN shuffle_ratio > 0.5 THEN printf('- Shuffle: %.2fGB (%.0f%%{of} - inefficient join)', gb, shuffle_ratio * 100) WHEN shuffle_ratio = 0 THEN printf('- Shuffle: %.0fGB (broadcast join - efficient but memory-intensive)', gb)
 ELSE printf('- Shuffle: %.2fGB (%.0f%%)', gb, shuffle_ratio * 100) END"""
CLUSTER_LINES = """concat('- Type: ', node_type), concat('- Executors: ', executor_count, ' x ', executor_memory), concat('- Total Memory: ', executor_count * CAST(regexp_extract(executor_memory, '^(\\d+)', 1) AS BIGINT), 'GB')"""


@query("C10_metric_lines", f"""SELECT statement_id, CASE lvl WHEN 'FULL' THEN concat_ws(chr(10), concat('- Duration: ', {SECONDS}, CASE WHEN execution_duration_ms > 60000 THEN ' (SLOW - needs optimization)' ELSE '' END),
 CASE WHEN daily_cost IS NOT NULL THEN printf('- Calculated Cost Impact: $%.2f/day', daily_cost) END, '- Data Scanned: ' || {GB}, '- Rows Processed: ' || format('{{:,}}', produced_rows), {SHUFFLE.format(of=" of scanned")}, {CLUSTER_LINES})
 WHEN 'METRICS_ONLY' THEN concat_ws(chr(10), '- Duration: ' || {SECONDS}, '- Data Scanned: ' || {GB}, '- Rows Processed: ' || format('{{:,}}', produced_rows), {SHUFFLE.format(of="")})
 ELSE concat_ws(chr(10), {CLUSTER_LINES}) END AS metric_lines
FROM (SELECT *, coalesce(shuffle_read_bytes, 0) / 1073741824.0::DOUBLE AS gb, CASE WHEN cluster_id IS NULL THEN 'METRICS_ONLY' WHEN event_id % 9 = 0 THEN 'CLUSTER_ONLY' ELSE 'FULL' END AS lvl FROM ({PRICED_SQL}))""")
def c10(spark, d):
    level = F.when(F.col("cluster_id").isNull(), "METRICS_ONLY").when(F.col("event_id") % 9 == 0, "CLUSTER_ONLY").otherwise("FULL")
    return reports.derived_metric_lines(priced(spark, d).withColumn("context_level", level)).select("statement_id", "metric_lines")
