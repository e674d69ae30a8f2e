"""Report texts as columns: JSON, Markdown and plain summaries per statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.functions.formats import fixed, grouped, with_unit
from workloom.functions.metrics import GIB, memory_gb_whole

RULE_LINE = "=" * 70
THIN_LINE = "-" * 70


def _numbered(violations: Column, line) -> Column:
    return F.transform(violations, lambda v, i: line(v, (i + 1).cast("string")))


def json_report(df: DataFrame) -> DataFrame:
    """Nested result document; needs violations, metrics and cluster columns."""
    doc = F.struct(
        F.col("statement_id").alias("query_id"), F.lit("post_execution").alias("analysis_type"),
        F.col("violation_count"),
        F.transform(F.col("violations"), lambda v: F.struct(
            v["rule_id"].alias("rule_id"), v["rule_key"].alias("rule_key"), v["severity"].alias("severity"),
            v["message"].alias("message"), v["fix"].alias("fix_suggestion"))).alias("violations"),
        F.struct(
            F.col("execution_duration_ms").alias("duration_ms"), F.col("read_bytes").alias("bytes_scanned"),
            F.col("produced_rows").alias("rows_scanned"), "read_rows",
            F.col("spilled_local_bytes").alias("spilled_bytes"), "shuffle_read_bytes",
        ).alias("execution_metrics"),
    )
    return df.select("statement_id", F.to_json(doc).alias("report"))


def markdown_report(df: DataFrame) -> DataFrame:
    head = F.concat(
        F.lit("# Statement analysis\n\n**Query ID:** `"), F.col("statement_id"), F.lit("`\n**Violations:** "),
        F.col("violation_count").cast("string"), F.lit("\n\n## Execution metrics\n\n- **Duration:** "),
        with_unit(F.col("execution_duration_ms") / 1000, 1, "s"), F.lit("\n- **Data scanned:** "),
        with_unit(F.col("read_bytes") / GIB, 2, "GB"), F.lit("\n"),
        F.when(F.col("cost_usd") > 0, F.concat(F.lit("- **Cost:** $"), fixed(F.col("cost_usd"), 2), F.lit("\n"))).otherwise(""),
    )
    body = F.array_join(_numbered(F.col("violations"), lambda v, n: F.concat(
        F.lit("\n### "), n, F.lit(". "), v["rule_id"], F.lit(" ("), v["severity"], F.lit(")\n\n"), v["message"],
        F.lit("\n\n**Fix:** "), v["fix"], F.lit("\n---\n"))), "")
    clean = F.concat(
        F.lit("# Statement analysis\n\n**Query ID:** `"), F.col("statement_id"), F.lit("`\n\nNo violations found"))
    text = F.when(F.col("violation_count") == 0, clean).otherwise(F.concat(head, F.lit("\n## Violations\n"), body))
    return df.select("statement_id", text.alias("report"))


def text_summary(df: DataFrame) -> DataFrame:
    seconds = with_unit(F.col("execution_duration_ms") / 1000, 1, "s")
    cost = F.when(F.col("cost_usd") > 0, F.concat(F.lit(" | Cost: $"), fixed(F.col("cost_usd"), 2))).otherwise("")
    clean = F.concat(
        F.lit("No violations found (Query ID: "), F.col("statement_id"), F.lit(")\n  Duration: "), seconds, cost)
    items = F.array_join(_numbered(F.col("violations"), lambda v, n: F.concat(
        F.lit("\n"), n, F.lit(". "), v["rule_id"], F.lit(" ["), F.upper(v["severity"]), F.lit("]\n   "), v["message"],
        F.lit("\n   Fix: "), v["fix"])), "\n")
    full = F.concat_ws(
        "\n", F.lit(RULE_LINE), F.concat(F.lit("Query ID: "), F.col("statement_id")),
        F.concat(F.lit("Duration: "), seconds, F.lit(" | Data Scanned: "), with_unit(F.col("read_bytes") / GIB, 2, "GB"), cost),
        F.lit(RULE_LINE), items, F.lit(THIN_LINE),
        F.concat(F.lit("Total: "), F.col("violation_count").cast("string"), F.lit(" violation(s)")), F.lit(RULE_LINE))
    return df.select("statement_id", F.when(F.col("violation_count") == 0, clean).otherwise(full).alias("report"))


def workspace_summary(totals: DataFrame, by_rule: DataFrame, worst: DataFrame) -> DataFrame:
    """One text for the whole workspace; the two lists hold at most ten rows each."""
    rules = by_rule.limit(10).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("violations")).alias("k"), F.col("rule_key"), F.col("violations")))).alias("rules"))
    tops = worst.limit(10).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("violation_count")).alias("k"), (-F.coalesce("cost_usd", F.lit(0.0))).alias("c"),
        (-F.col("total_duration_ms")).alias("d"), "statement_id", "violation_count", "cost_usd", "total_duration_ms",
    ))).alias("tops"))
    one = totals.withColumn("one", F.lit(1)).join(rules.withColumn("one", F.lit(1)), "one").join(
        tops.withColumn("one", F.lit(1)), "one")
    text = F.concat_ws(
        "\n", F.lit("Overview:"),
        F.concat(F.lit("  Total Queries Analyzed: "), grouped(F.col("total_statements"))),
        F.concat(F.lit("  Queries with Violations: "), grouped(F.col("statements_with_violations")), F.lit(" ("),
                 fixed(F.col("violation_rate"), 1), F.lit("%)")),
        F.concat(F.lit("  Total Violations: "), grouped(F.col("total_violations"))),
        F.concat(F.lit("  Total Cost: $"), grouped(F.col("total_cost_usd"), 2)),
        F.lit("Top Violation Types:"),
        F.array_join(F.transform("rules", lambda r: F.concat(F.lit("  "), r["rule_key"], F.lit(": "), grouped(r["violations"]))), "\n"),
        F.lit("Worst Performers:"),
        F.array_join(F.transform("tops", lambda q, i: F.concat(
            F.lit("  "), (i + 1).cast("string"), F.lit(". Query "), q["statement_id"], F.lit(" | "),
            q["violation_count"].cast("string"), F.lit(" violations | Cost: "),
            F.when(q["cost_usd"] > 0, F.concat(F.lit("$"), fixed(q["cost_usd"], 2))).otherwise("N/A"),
            F.lit(" | Duration: "), with_unit(q["total_duration_ms"] / 1000, 1, "s"))), "\n"))
    return one.select(text.alias("summary"))


def _shuffle_line(with_context: bool) -> Column:
    ratio, gb = F.col("shuffle_ratio"), F.coalesce("shuffle_read_bytes", F.lit(0)) / GIB
    percent = with_unit(ratio * 100, 0, "%")
    of_scan = " of scanned" if with_context else ""
    return F.when(ratio.isNotNull(), F.concat(
        F.lit("- Shuffle: "),
        F.when(ratio > 1.0, F.concat(with_unit(gb, 2, "GB ("), percent, F.lit(of_scan + " - CARTESIAN JOIN LIKELY)")))
        .when(ratio > 0.5, F.concat(with_unit(gb, 2, "GB ("), percent, F.lit(of_scan + " - inefficient join)")))
        .when(ratio == 0.0, F.concat(with_unit(gb, 0, "GB (broadcast join - efficient but memory-intensive)")))
        .otherwise(F.concat(with_unit(gb, 2, "GB ("), percent, F.lit(")")))))


def derived_metric_lines(df: DataFrame) -> DataFrame:
    """Metric and cluster lines; the variant follows from what is known.

    ``context_level`` is FULL, METRICS_ONLY or CLUSTER_ONLY.
    """
    seconds = F.col("execution_duration_ms") / 1000
    duration = F.concat(F.lit("- Duration: "), with_unit(seconds, 1, "s"))
    slow = F.concat(duration, F.when(seconds > 60, " (SLOW - needs optimization)").otherwise(""))
    scanned = F.concat(F.lit("- Data Scanned: "), with_unit(F.col("read_bytes") / GIB, 2, "GB"))
    rows = F.concat(F.lit("- Rows Processed: "), grouped(F.col("produced_rows")))
    cost = F.when(F.col("daily_cost").isNotNull(), F.concat(
        F.lit("- Calculated Cost Impact: $"), fixed(F.col("daily_cost"), 2), F.lit("/day")))
    total = F.col("executor_count") * memory_gb_whole(F.col("executor_memory"))
    cluster = [
        F.concat(F.lit("- Type: "), F.col("node_type")),
        F.concat(F.lit("- Executors: "), F.col("executor_count").cast("string"), F.lit(" x "), F.col("executor_memory")),
        F.concat(F.lit("- Total Memory: "), total.cast("string"), F.lit("GB")),
    ]
    full = F.concat_ws("\n", slow, cost, scanned, rows, _shuffle_line(True), *cluster)
    metrics = F.concat_ws("\n", duration, scanned, rows, _shuffle_line(False))
    level = F.col("context_level")
    return df.withColumn("metric_lines", F.when(level == "FULL", full).when(
        level == "METRICS_ONLY", metrics).otherwise(F.concat_ws("\n", *cluster)))
