"""Text protection over statements, conversations, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from workloom.functions import text as tx
from workloom.operators import protection as ops
from workloom.plans.history import H, history
from workloom.plans.registry import query
from workloom.sources.tables import table
from workloom.sources.workload import view, view_sql

CHAT = view_sql("chat")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_sql(column: str) -> str:
    out = f"regexp_replace({column}, '--[^\\n]*', '', 'g')"
    out = f"regexp_replace({out}, '(?m)[ \\t]+$', '', 'g')"
    out = f"regexp_replace({out}, '(?s)/\\*.*?\\*/', '', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


def hits_sql(column: str) -> str:
    return "list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches({column}, {q(p)}) THEN {q(p)} END" for p in tx.INJECTION_PATTERNS
    ) + "], lambda p: p IS NOT NULL)"


def block_sql(column: str, limit: int | None = None) -> str:
    for p in tx.INJECTION_PATTERNS:
        column = f"regexp_replace({column}, {q(p)}, '[BLOCKED]', 'g')"
    column = f"regexp_replace(replace(replace({column}, '\\', '\\\\'), '\"', '\\\"'), '\\n\\n+', chr(10) || chr(10), 'g')"
    if limit is None:
        return column
    return f"(CASE WHEN length({column}) > {limit} THEN substr({column}, 1, {limit - 3}) || '...' ELSE {column} END)"


SEVERITY_SQL = f"""CASE WHEN list_has_any(hits, [{', '.join(q(p) for p in tx.CRITICAL_PATTERNS)}]) THEN 'critical' WHEN len(hits) >= 3 THEN 'warning' ELSE 'info' END"""


@query("X1_comment_removal", f"SELECT statement_id, {strip_sql('statement_text')} AS clean_text FROM {H}")
def x1(spark, d):
    return history(spark, d).select("statement_id", tx.strip_comments(F.col("statement_text")).alias("clean_text"))


@query("X2_injection_scan", f"SELECT conv_id, turn, array_to_string({hits_sql('message')}, ' ; ') AS hits FROM {CHAT}")
def x2(spark, d):
    return view(spark, d, "chat").select("conv_id", "turn", F.array_join(tx.injection_hits(F.col("message")), " ; ").alias("hits"))


@query("X3_injection_blocking", f"SELECT conv_id, turn, {block_sql('message')} AS safe, {block_sql('message', 120)} AS safe_short FROM {CHAT}")
def x3(spark, d):
    return view(spark, d, "chat").select(
        "conv_id", "turn", tx.block_injections(F.col("message")).alias("safe"), tx.block_injections(F.col("message"), 120).alias("safe_short"))


@query("X4_context_blocking", f"""SELECT conv_id, turn, {block_sql('message', 500)} AS first_item, array_to_string(list_transform(string_split(message, chr(10)), lambda part: {block_sql('part', 500)}), '|') AS lines FROM {CHAT}""")
def x4(spark, d):
    context = F.create_map(F.lit("message"), F.array("message"), F.lit("lines"), F.split("message", "\n"))
    safe = tx.block_context(context, 500)
    return view(spark, d, "chat").select("conv_id", "turn", safe.alias("c")).select(
        "conv_id", "turn", F.col("c.message")[0].alias("first_item"), F.array_join(F.col("c.lines"), "|").alias("lines"))


SANITISED = f"(SELECT *, len(hits) > 0 AS is_suspicious FROM (SELECT *, {hits_sql('clean_text')} AS hits FROM (SELECT *, {strip_sql('statement_text')} AS clean_text FROM {H})))"


@query("X5_statement_sanitising", f"SELECT statement_id, clean_text, is_suspicious FROM {SANITISED}")
def x5(spark, d):
    return ops.sanitised_statements(history(spark, d)).select("statement_id", "clean_text", "is_suspicious")


@query("X6_injection_severity", f"SELECT conv_id, turn, {SEVERITY_SQL} AS severity FROM (SELECT *, {hits_sql('message')} AS hits FROM {CHAT})")
def x6(spark, d):
    return view(spark, d, "chat").select("conv_id", "turn", tx.injection_severity(tx.injection_hits(F.col("message"))).alias("severity"))


@query("X7_audit_entries", f"""SELECT statement_id, start_time AS event_time, sha256(clean_text) AS query_hash, substr(clean_text, 1, 500) AS query_preview, array_to_string(hits, ' ; ') AS patterns_detected, {SEVERITY_SQL} AS severity,
 executed_by AS user_id, coalesce(warehouse_id, 'unknown') AS session_id FROM {SANITISED} WHERE is_suspicious""")
def x7(spark, d):
    entries = ops.audit_entries(ops.sanitised_statements(history(spark, d)), "start_time", "executed_by", "warehouse_id")
    return entries.withColumn("patterns_detected", F.array_join("patterns_detected", " ; "))


def scrub_sql(column: str) -> str:
    for pattern, replacement in tx.ERROR_SCRUBS:
        column = f"regexp_replace({column}, {q(pattern)}, {q(replacement.replace('$1', chr(92) + '1'))}, 'g')"
    return column


FRIENDLY_SQL = "CASE error_type " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in tx.FRIENDLY_ERRORS.items()) + f" ELSE '{tx.FRIENDLY_DEFAULT}' END"


@query("X8_error_scrubbing", f"""SELECT statement_id, error_type || ': ' || {FRIENDLY_SQL} || ': ' || {scrub_sql('error_message')} AS safe_message FROM {H} WHERE error_message IS NOT NULL""")
def x8(spark, d):
    h = history(spark, d).filter(F.col("error_message").isNotNull())
    return h.select("statement_id", tx.scrub_error(F.col("error_message"), F.col("error_type")).alias("safe_message"))


@query("X8_page_scrubbing", f"""SELECT page_id, 'An error occurred: ' || {scrub_sql('html')} AS safe_message FROM pages""")
def x8p(spark, d):
    return table(spark, d, "pages").select("page_id", tx.scrub_error(F.col("html"), F.lit("PageError"), include_type=False).alias("safe_message"))


@query("X9_security_alerts", f"""SELECT event_id, event_type, CASE WHEN event_type = 'detector_load' THEN risk_level END AS risk_level, CAST(json_extract_string(props, '$.k') AS BIGINT) AS payload_k,
 (event_type = 'detector_load' AND risk_level IN ('high', 'critical')) OR event_type = 'prompt_injection_attempt' AS alert FROM {view_sql('security_events')}""")
def x9(spark, d):
    return ops.security_alerts(view(spark, d, "security_events"))
