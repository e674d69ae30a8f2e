"""Text protection jobs: sanitised statements, audit entries, security events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloom.functions import text as tx


def sanitised_statements(df: DataFrame, column: str = "statement_text") -> DataFrame:
    """Comments removed first, then the scan: a pattern inside a comment is not reported."""
    clean = df.withColumn("clean_text", tx.strip_comments(F.col(column)))
    return clean.withColumn("hits", tx.injection_hits(F.col("clean_text"))).withColumn(
        "is_suspicious", F.size("hits") > 0)


def audit_entries(sanitised: DataFrame, time_column: str, user_column: str, session_column: str | None = None) -> DataFrame:
    """One entry per suspicious text; missing user and session become ``unknown``."""
    session = F.col(session_column) if session_column else F.lit(None).cast("string")
    filled = lambda c: F.coalesce(F.when(c != "", c), F.lit("unknown"))
    return sanitised.filter("is_suspicious").select(
        F.col(time_column).alias("event_time"),
        F.sha2("clean_text", 256).alias("query_hash"),
        F.substring("clean_text", 1, 500).alias("query_preview"),
        F.col("hits").alias("patterns_detected"),
        tx.injection_severity(F.col("hits")).alias("severity"),
        filled(F.col(user_column)).alias("user_id"),
        filled(session).alias("session_id"),
        F.col("statement_id"),
    )


def security_alerts(events: DataFrame) -> DataFrame:
    """Payload opened and an alert flag: risky loads and every injection attempt."""
    payload = F.from_json("props", "k bigint")
    risky = (F.col("event_type") == "detector_load") & F.col("risk_level").isin("high", "critical")
    return events.select(
        "event_id", "event_type",
        F.when(F.col("event_type") == "detector_load", F.col("risk_level")).alias("risk_level"),
        payload["k"].alias("payload_k"),
        (risky | (F.col("event_type") == "prompt_injection_attempt")).alias("alert"),
    )
