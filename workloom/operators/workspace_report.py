"""The workspace analysis as one job: candidates, cluster, utilisation, cost, findings, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloom.operators import detectors, discovery, enrich, rollups
from workloom.session import written


def analyze_workspace(
    history: DataFrame, changes: DataFrame, node_types: DataFrame, timeline: DataFrame, as_of: str, *,
    rules: DataFrame | None = None, keys: list[str] | None = None, hours: int = 168, min_duration_ms: int = 0,
    users: list[str] | None = None, min_cost_usd: float | None = None, worst: int = 50, **facts: DataFrame,
) -> dict[str, DataFrame]:
    """Frames ``statements``, ``violations``, ``totals``, ``by_rule``, ``by_user`` and ``worst``.

    Candidates are filtered first and enriched once; statements and findings are written to the
    shared folder, so the roll-ups read two narrow tables instead of running the job again.
    ``rules`` sets severities and messages and switches rules off; ``facts`` are the measured
    tables of ``detectors.with_context``.
    """
    chosen = discovery.workspace_candidates(
        history, as_of, hours, min_duration_ms, users=users, min_cost_usd=min_cost_usd)
    found = detectors.detect_statements(chosen, keys or detectors.DEFAULT_RULES, **facts)
    if rules is not None:
        found = detectors.with_rule_config(found, rules)
    violations = written(found)
    full = enrich.enriched(chosen, changes, node_types, timeline).withColumnRenamed("task_cost", "cost_usd")
    statements = written(full.join(rollups.per_statement(violations), "statement_id", "left").withColumn(
        "violation_count", F.coalesce("violation_count", F.lit(0))))
    plain = statements.drop("violation_count")
    return {
        "statements": statements, "violations": violations,
        "totals": rollups.totals(plain, violations), "by_rule": rollups.by_rule(violations),
        "by_user": rollups.by_user(plain, violations),
        "worst": rollups.worst_statements(plain, violations, worst),
    }
