"""Roll-ups of findings and costs: totals, by rule, user, day and statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# Severity of a pattern when nothing else is known; anything else is medium.
PATTERN_SEVERITY = {
    "CARTESIAN_JOIN": "critical",
    "SELECT_STAR": "high",
    "MISSING_PARTITION_FILTER": "high",
    "NON_SARGABLE": "medium",
}


def per_statement(violations: DataFrame) -> DataFrame:
    return violations.groupBy("statement_id").agg(F.count("*").alias("violation_count"))


def totals(statements: DataFrame, violations: DataFrame) -> DataFrame:
    """``statements`` has statement_id and cost_usd."""
    joined = statements.join(per_statement(violations), "statement_id", "left")
    n = F.coalesce("violation_count", F.lit(0))
    return joined.agg(
        F.count("*").alias("total_statements"),
        F.count(F.when(n > 0, 1)).alias("statements_with_violations"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_violations"),
        F.coalesce(F.sum(F.coalesce("cost_usd", F.lit(0.0))), F.lit(0.0)).alias("total_cost_usd"),
    ).withColumn(
        "violation_rate",
        F.col("statements_with_violations") / F.greatest("total_statements", F.lit(1)) * 100,
    )


def by_rule(violations: DataFrame, limit: int | None = None) -> DataFrame:
    out = violations.groupBy("rule_key").agg(F.count("*").alias("violations")).orderBy(
        F.desc("violations"), "rule_key")
    return out if limit is None else out.limit(limit)


def by_user(statements: DataFrame, violations: DataFrame) -> DataFrame:
    """Findings per user; users without any stay with zero."""
    joined = statements.select("statement_id", "executed_by").join(per_statement(violations), "statement_id", "left")
    return joined.groupBy("executed_by").agg(F.sum(F.coalesce("violation_count", F.lit(0))).alias("violations"))


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    return F.coalesce(F.element_at(ranks, severity), F.lit(0))


def overall_severity(violations: DataFrame) -> DataFrame:
    """The worst fixed severity of the patterns found in a statement."""
    fixed = F.create_map(*[F.lit(x) for kv in PATTERN_SEVERITY.items() for x in kv])
    rated = violations.withColumn("pattern_severity", F.coalesce(F.element_at(fixed, F.col("rule_key")), F.lit("medium")))
    return rated.groupBy("statement_id").agg(
        F.max_by("pattern_severity", severity_rank(F.col("pattern_severity"))).alias("overall_severity"),
        F.lit(0.5).alias("confidence"),
    )


def worst_statements(statements: DataFrame, violations: DataFrame, limit: int = 50) -> DataFrame:
    """Most findings first, then cost; ties by duration and id."""
    joined = statements.join(per_statement(violations), "statement_id", "left").withColumn(
        "violation_count", F.coalesce("violation_count", F.lit(0)))
    return joined.orderBy(
        F.desc("violation_count"), F.desc(F.coalesce("cost_usd", F.lit(0.0))),
        F.desc("total_duration_ms"), "statement_id",
    ).limit(limit)


def confidence_level(has_metrics: Column, has_cluster: Column, violations: Column) -> Column:
    return (
        F.when(has_metrics & has_cluster & (violations > 1), "FULL")
        .when(has_cluster, "CLUSTER_ONLY").when(has_metrics, "METRICS_ONLY").otherwise("MINIMAL")
    )


def gate(statements: DataFrame, violations: DataFrame) -> DataFrame:
    """Reject a statement that has a critical finding."""
    critical = violations.groupBy("statement_id").agg(
        F.count(F.when(F.col("severity") == "critical", 1)).alias("critical_count"))
    return statements.select("statement_id").join(critical, "statement_id", "left").select(
        "statement_id", F.coalesce("critical_count", F.lit(0)).alias("critical_count"),
        F.when(F.coalesce("critical_count", F.lit(0)) > 0, "reject").otherwise("pass").alias("gate"),
    )


def security_stats(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.agg(
        F.count("*").alias("total_events"),
        F.count(F.when(kind == "detector_load", 1)).alias("detector_loads"),
        F.count(F.when(kind == "prompt_injection_attempt", 1)).alias("prompt_injections"),
        F.count(F.when(kind == "detector_timeout", 1)).alias("timeouts"),
        F.count(F.when(kind == "resource_violation", 1)).alias("resource_violations"),
        F.count(F.when((kind == "detector_load") & F.col("risk_level").isin("high", "critical"), 1)).alias("high_risk_loads"),
    )


def entries_per_minute(entries: DataFrame, time_column: str) -> DataFrame:
    return entries.groupBy(F.date_trunc("minute", time_column).alias("minute")).agg(F.count("*").alias("entries"))
