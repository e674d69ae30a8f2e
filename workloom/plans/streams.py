"""Streaming jobs run over the available input, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from workloom.functions.formats import rounded, rounded_sql
from workloom.operators.detectors import DEFAULT_RULES
from workloom.plans.detection import expected_sql
from workloom.plans.history import H, history
from workloom.plans.joins import CLUSTER_SQL
from workloom.plans.protection import SANITISED, SEVERITY_SQL
from workloom.plans.registry import query
from workloom.sources.tables import table
from workloom.sources.workload import VIEWS, node_types, view, view_sql
from workloom.streaming import admission, jobs

NTZ = "timestamp_ntz"
COST = "value / 1000"


def stream_view(spark, d, name, source):
    """A derived view over a file stream instead of a table."""
    return spark.sql(VIEWS[name].replace("{ts}", "TIMESTAMP_NTZ"), **{source: jobs.file_stream(spark, d, source)})


@query("W5_offered_load", """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS requests_last_minute,
 floor(sum(value / 1000) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS cost_last_hour FROM events""")
def w5(spark, d):
    e = table(spark, d, "events").withColumn("cost", F.expr(COST))
    out = admission.offered_load(e, "user_id", "cost")
    return out.select("event_id", "user_id", "requests_last_minute", rounded(F.col("cost_last_hour"), 6).alias("cost_last_hour"))


# Decisions one after the other: each step takes the next event of every user.
T1_SQL = """WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, CAST(floor(value / 1000 * 1e6 + 0.5) AS BIGINT) AS cost,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS decision, []::STRUCT(t BIGINT, c BIGINT)[] AS adm
  FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, rn, event_id, decision, CASE WHEN decision = 'admitted' THEN list_append(kept, struct_pack(t := us, c := cost)) ELSE kept END
  FROM (SELECT *, CASE WHEN len(list_filter(kept, lambda x: x.t > us - 60000000)) >= 1 THEN 'requests'
      WHEN coalesce(list_sum(list_transform(kept, lambda x: x.c)), 0) + cost > 60000 THEN 'cost' ELSE 'admitted' END AS decision
    FROM (SELECT e.user_id, e.rn, e.event_id, e.us, e.cost, list_filter(r.adm, lambda x: x.t > e.us - 3600000000) AS kept
      FROM r JOIN e ON e.user_id IS NOT DISTINCT FROM r.user_id AND e.rn = r.rn + 1)))
 SELECT user_id AS key, event_id, decision FROM r WHERE rn > 0"""
T2_SQL = """WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 r AS (
  SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS decision, NULL::BIGINT AS start, 0::BIGINT AS n
  FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN n >= 1 THEN 'dropped' ELSE 'admitted' END, start, least(n + 1, 1)
  FROM (SELECT e.user_id, e.rn, e.event_id, CASE WHEN fresh THEN e.at ELSE r.start END AS start, CASE WHEN fresh THEN 0 ELSE r.n END AS n
    FROM (SELECT *, r.user_id AS u FROM r) r JOIN e ON e.user_id IS NOT DISTINCT FROM r.u AND e.rn = r.rn + 1,
      LATERAL (SELECT r.start IS NULL OR e.at - r.start >= 60000000 AS fresh)))
 SELECT user_id AS key, event_id, decision FROM r WHERE rn > 0"""
LIMITS = admission.Limits(per_minute=1, cost_per_hour=0.06)


@query("T1_admission", T1_SQL)
def t1(spark, d):
    """Admission per user by the cost of each event, with limits that the data reaches."""
    return admission.admit(table(spark, d, "events"), "user_id", LIMITS, cost=COST)


@query("T1_admission_stream", T1_SQL)
def t1s(spark, d):
    stream, close = jobs.closable(jobs.file_stream(spark, d, "events"))
    out = admission.admit_stream(stream, "user_id", LIMITS, cost=COST)
    return spark.read.parquet(jobs.run_to_folder(out, close=close)).drop("batch_id")


@query("T2_minute_cap", T2_SQL)
def t2(spark, d):
    return admission.cap_per_minute(table(spark, d, "events"), "user_id", cap=1)


@query("T2_minute_cap_stream", T2_SQL)
def t2s(spark, d):
    stream, close = jobs.closable(jobs.file_stream(spark, d, "events"))
    out = admission.cap_stream(stream, "user_id", cap=1)
    return spark.read.parquet(jobs.run_to_folder(out, close=close)).drop("batch_id")


T3_SQL = f"""SELECT date_trunc('minute', ts) AS window_start, count(*) AS requests, {rounded_sql('count(*) / 60::DOUBLE * 100', 6)} AS utilisation_percent, greatest(60 - count(*), 0) AS remaining FROM events GROUP BY 1"""


def t3_shape(df):
    return df.select(F.col("window_start").cast(NTZ).alias("window_start"), "requests", rounded(F.col("utilisation_percent"), 6).alias("utilisation_percent"), "remaining")


@query("T3_request_counters", T3_SQL)
def t3(spark, d):
    return t3_shape(jobs.request_counters(table(spark, d, "events")))


@query("T3_request_counters_stream", T3_SQL)
def t3s(spark, d):
    path = jobs.run_to_folder(jobs.request_counters(jobs.file_stream(spark, d, "events")), mode="update")
    return t3_shape(jobs.read_latest(spark, path, ["window_start"]))


@query("T3_cost_counters", f"""SELECT w AS window_start, {rounded_sql('sum(value / 1000)', 6)} AS cost, {rounded_sql('sum(value / 1000) / 10::DOUBLE * 100', 4)} AS utilisation_percent, {rounded_sql('greatest(10 - sum(value / 1000), 0)', 6)} AS remaining
 FROM (SELECT value, time_bucket(INTERVAL '5 minutes', ts) - k * INTERVAL '5 minutes' AS w FROM events, range(12) r(k)) GROUP BY 1""")
def t3c(spark, d):
    out = jobs.cost_counters(table(spark, d, "events"), F.expr(COST))
    return out.select(F.col("window_start").cast(NTZ).alias("window_start"), rounded(F.col("cost"), 6).alias("cost"),
                      rounded(F.col("utilisation_percent"), 4).alias("utilisation_percent"), rounded(F.col("remaining"), 6).alias("remaining"))


T4_SQL = f"SELECT statement_id, sha256(clean_text) AS query_hash, {SEVERITY_SQL} AS severity, executed_by AS user_id, coalesce(warehouse_id, 'unknown') AS session_id FROM {SANITISED} WHERE is_suspicious"


@query("T4_injection_audit_stream", T4_SQL)
def t4(spark, d):
    path = jobs.run_to_folder(jobs.injection_audit(stream_view(spark, d, "history", "events")))
    return spark.read.parquet(path).select("statement_id", "query_hash", "severity", "user_id", "session_id")


T5_SQL = f"SELECT DISTINCT sha256(clean_text) AS query_hash FROM {SANITISED} WHERE is_suspicious"


@query("T5_audit_dedup", T5_SQL)
def t5(spark, d):
    return jobs.injection_audit(history(spark, d)).dropDuplicates(["query_hash"]).select("query_hash")


@query("T5_audit_dedup_stream", T5_SQL)
def t5s(spark, d):
    entries = jobs.injection_audit(stream_view(spark, d, "history", "events"))
    return spark.read.parquet(jobs.run_to_folder(jobs.deduplicated_audit(entries))).select("query_hash")


T6_SQL = f"SELECT date_trunc('day', h.start_time)::TIMESTAMP AS day, e.rule_key, count(*) AS violations FROM {H} h JOIN ({expected_sql(DEFAULT_RULES)}) e ON h.statement_id = e.statement_id WHERE h.execution_status = 'FINISHED' GROUP BY ALL"


def day_ntz(df):
    return df.withColumn("day", F.col("day").cast(NTZ))


@query("T6_violation_counts", T6_SQL)
def t6(spark, d):
    return day_ntz(jobs.violation_counts(history(spark, d)))


@query("T6_violation_counts_stream", T6_SQL)
def t6s(spark, d):
    path = jobs.run_to_folder(jobs.violation_counts(stream_view(spark, d, "history", "events")), mode="update")
    return day_ntz(jobs.read_latest(spark, path, ["day", "rule_key"]))


T7_SQL = f"""SELECT date_trunc('hour', ts) AS hour, count(*) AS total, count(*) FILTER (event_type = 'detector_load') AS detector_load, count(*) FILTER (event_type = 'prompt_injection_attempt') AS prompt_injection_attempt,
 count(*) FILTER (event_type = 'detector_timeout') AS detector_timeout, count(*) FILTER (event_type = 'resource_violation') AS resource_violation FROM {view_sql('security_events')} GROUP BY 1"""


@query("T7_security_counters", T7_SQL)
def t7(spark, d):
    return jobs.security_counters(view(spark, d, "security_events")).withColumn("hour", F.col("hour").cast(NTZ))


@query("T7_security_counters_stream", T7_SQL)
def t7s(spark, d):
    path = jobs.run_to_folder(jobs.security_counters(stream_view(spark, d, "security_events", "events")), mode="update")
    return jobs.read_latest(spark, path, ["hour"]).withColumn("hour", F.col("hour").cast(NTZ))


@query("T8_enriched_stream", f"SELECT statement_id, cluster_id, node_type, executor_count, executor_memory FROM ({CLUSTER_SQL})")
def t8(spark, d):
    path = jobs.enriched_stream(stream_view(spark, d, "history", "events"), view(spark, d, "clusters"), node_types(spark))
    return spark.read.parquet(path).select("statement_id", "cluster_id", "node_type", "executor_count", "executor_memory")
