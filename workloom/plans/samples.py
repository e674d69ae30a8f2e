"""Sample tables and corpus, analytic shapes, plug-ins, file sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from workloom.functions.lexical import text_key
from workloom.functions.formats import rounded, rounded_sql
from workloom.functions.sql_functions import register_sql_functions
from workloom.operators import context as ctx
from workloom.operators import detectors as det
from workloom.operators import generators, governance, protection
from workloom.plans.detection import EXPECTED, history, values_sql, violations
from workloom.plans.governance import TABLES_CASE
from workloom.plans.history import H
from workloom.plans.metrics import IO_SQL, NET_SQL, PERF_SQL, PRICED_SQL, priced
from workloom.plans.protection import SANITISED, SEVERITY_SQL
from workloom.plans.registry import query
from workloom.plans.rollups import TEXTS
from workloom.session import shared_folder
from workloom.sources import sinks, workspace
from workloom.sources.tables import table
from workloom.sources.workload import view, view_sql

# Demo table -> (given table that provides the row ids, id column)
FAMILIES = {
    "F3": {"financial_customers": ("customer", "c_custkey"), "financial_transactions": ("orders", "o_orderkey"), "financial_fraud_alerts": ("supplier", "s_suppkey")},
    "F4": {"healthcare_patients": ("customer", "c_custkey"), "healthcare_appointments": ("orders", "o_orderkey"), "healthcare_prescriptions": ("orders", "o_orderkey")},
    "F5": {"energy_customers": ("customer", "c_custkey"), "energy_smart_meter_readings": ("orders", "o_orderkey"), "energy_outages": ("supplier", "s_suppkey")},
    "F6": {"enterprise_users": ("customer", "c_custkey"), "enterprise_events": ("events", "event_id"), "enterprise_products": ("part", "p_partkey")},
}


def as_plain(df):
    """Decimals as doubles, so that both engines show them alike."""
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def as_plain_sql(name: str, source: str, key: str) -> str:
    kinds = {"account_balance", "amount", "cost_gbp", "kwh_consumed", "tariff_rate", "price"}
    cols = [k for k in generators.TABLES[name] if not k.startswith("_")]
    return "SELECT " + ", ".join(f"{c}::DOUBLE AS {c}" if c in kinds else c for c in cols) + " FROM " + generators.build_sql(name, source, key)


def generated(prefix: str, name: str, source: str, key: str):
    @query(f"{prefix}_{name}", as_plain_sql(name, source, key))
    def run(spark, d):
        return as_plain(generators.build(name, table(spark, d, source), key))


for _prefix, _tables in FAMILIES.items():
    for _name, (_source, _key) in _tables.items():
        generated(_prefix, _name, _source, _key)


# --- plug-in rule and SQL functions --------------------------------------------------------------

@query("F1_custom_rule", f"SELECT statement_id, 'LIMIT_MISSING' AS rule_key, 'low' AS severity FROM {H} WHERE template_id <> 18 AND template_id <> 19")
def f1(spark, d):
    """A user rule: a SELECT without LIMIT."""
    def check():
        code = det.S.code
        bare = code.rlike(r"(?i)\bSELECT\b") & ~code.rlike(r"(?i)\bLIMIT\b")
        return F.when(bare, F.array(det.finding("low", F.lit("no LIMIT"), F.lit("Add a LIMIT"))))

    if "LIMIT_MISSING" not in det.RULES:
        det.register_rule("LIMIT_MISSING", "TEAM_001", "low", check)
    try:
        return det.detect_statements(history(spark, d), ["LIMIT_MISSING"]).select("statement_id", "rule_key", "severity")
    finally:
        det.unregister_rule("LIMIT_MISSING")


@query("F2_sql_functions", f"""SELECT statement_id, CASE WHEN execution_duration_ms / 1000::DOUBLE < 60 THEN printf('%.1fs', execution_duration_ms / 1000::DOUBLE) ELSE printf('%.1fm', execution_duration_ms / 1000::DOUBLE / 60) END AS duration,
 CASE WHEN read_bytes / 1073741824::DOUBLE < 1 THEN printf('%.1fMB', read_bytes / 1048576::DOUBLE) ELSE printf('%.2fGB', read_bytes / 1073741824::DOUBLE) END AS bytes, (event_id % 900)::DOUBLE / 1024 AS memory_gb, 'main.default.' || executed_by AS full_name FROM {H}""")
def f2(spark, d):
    register_sql_functions(spark)
    return spark.sql(
        "SELECT statement_id, wl_duration(execution_duration_ms) AS duration, wl_bytes(read_bytes) AS bytes, "
        "wl_memory_gb(concat(event_id % 900, ' MB')) AS memory_gb, wl_table_name(executed_by) AS full_name FROM {h}", h=history(spark, d))


# --- corpus --------------------------------------------------------------------------------------

BAD = sorted({r[0] for r in EXPECTED})
PATTERN_CASE = "CASE template_id " + " ".join(
    f"WHEN {t} THEN '{next(r[1] for r in EXPECTED if r[0] == t)}'" for t in BAD) + " ELSE NULL END"
CORPUS = f"""SELECT concat(upper(substr(CASE event_id % 4 WHEN 0 THEN 'financial' WHEN 1 THEN 'healthcare' WHEN 2 THEN 'energy' ELSE 'enterprise' END, 1, 3)), '_', statement_id) AS query_id,
 CASE event_id % 4 WHEN 0 THEN 'financial' WHEN 1 THEN 'healthcare' WHEN 2 THEN 'energy' ELSE 'enterprise' END AS industry,
 CASE WHEN template_id IN ({', '.join(map(str, BAD))}) THEN 'bad' ELSE 'good' END AS quality, {PATTERN_CASE} AS anti_pattern_type, statement_text AS query_text,
 CASE WHEN template_id IN (3, 4, 5, 1) THEN 'critical' WHEN template_id IN ({', '.join(map(str, BAD))}) THEN 'high' ELSE 'optimal' END AS expected_cost_impact,
 CASE WHEN event_id % 2 = 0 THEN 'data_analyst' ELSE 'senior_engineer' END AS persona FROM """


def corpus(spark, d):
    return spark.sql(CORPUS + "{h}", h=history(spark, d))


@query("S16_sample_corpus", CORPUS + H)
def s16(spark, d):
    return corpus(spark, d)


@query("P12_corpus_selection", f"""SELECT 'industry' AS choice, query_id FROM ({CORPUS + H}) WHERE industry = 'energy' UNION ALL SELECT 'good', query_id FROM ({CORPUS + H}) WHERE quality = 'good'
 UNION ALL SELECT 'pattern', query_id FROM ({CORPUS + H}) WHERE anti_pattern_type = 'CARTESIAN_JOIN' UNION ALL SELECT 'critical', query_id FROM ({CORPUS + H}) WHERE expected_cost_impact = 'critical'""")
def p12(spark, d):
    """One scan: each row is repeated for the choices it meets."""
    picks = {"industry": F.col("industry") == "energy", "good": F.col("quality") == "good",
             "pattern": F.col("anti_pattern_type") == "CARTESIAN_JOIN", "critical": F.col("expected_cost_impact") == "critical"}
    met = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in picks.items()]))
    return corpus(spark, d).select(F.explode(met).alias("choice"), "query_id")


# --- analytic shapes -----------------------------------------------------------------------------

@query("E1_join_range_in", """SELECT c_custkey, c_name, c_acctbal, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey
 WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01' AND o_totalprice > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def e1(spark, d):
    o = table(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1996-02-01' AND o_totalprice > 1000")
    c = table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "c_name", "c_acctbal", "o_orderkey", "o_totalprice")


@query("E2_having_top", f"""SELECT l_suppkey, count(*) AS n, {rounded_sql('sum(l_extendedprice)', 2)} AS total, {rounded_sql('avg(l_extendedprice)', 4)} AS mean FROM lineitem
 WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'N' GROUP BY l_suppkey HAVING count(*) > 3 ORDER BY sum(l_extendedprice) DESC, l_suppkey LIMIT 100""")
def e2(spark, d):
    lines = table(spark, d, "lineitem").filter(
        "l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1997-01-01' AND l_returnflag = 'N'")
    out = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"), F.avg("l_extendedprice").alias("mean"))
    return out.filter("n > 3").orderBy(F.desc("total"), "l_suppkey").limit(100).withColumns(
        {"total": rounded(F.col("total"), 2), "mean": rounded(F.col("mean"), 4)})


@query("E3_join_group", f"""SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders, {rounded_sql('sum(o_totalprice)', 2)} AS total FROM customer JOIN orders ON c_custkey = o_custkey
 WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01' AND o_orderpriority = '1-URGENT' GROUP BY 1, 2""")
def e3(spark, d):
    o = table(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-07-01' AND o_orderpriority = '1-URGENT'")
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("total"))
    c = table(spark, d, "customer")
    return c.join(per, c.c_custkey == per.o_custkey).select("c_custkey", "c_mktsegment", "orders", rounded(F.col("total"), 2).alias("total"))


@query("E4_avg_product_sum", f"""SELECT s_suppkey, s_nationkey, {rounded_sql('avg(l_quantity)', 6)} AS mean_quantity, {rounded_sql('sum(l_extendedprice * (1 - l_discount))', 2)} AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey
 WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' AND s_acctbal > 0 GROUP BY 1, 2""")
def e4(spark, d):
    """The lines are summed per supplier before the join, so a hot supplier never meets it whole."""
    lines = table(spark, d, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ '1996-01-01' AND l_shipdate < TIMESTAMP_NTZ '1996-04-01'")
    per = lines.groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("q"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    s = table(spark, d, "supplier").filter("s_acctbal > 0")
    return s.join(per, s.s_suppkey == per.l_suppkey).select(
        "s_suppkey", "s_nationkey", rounded(F.col("q"), 6).alias("mean_quantity"), rounded(F.col("r"), 2).alias("revenue"))


@query("E5_event_distinct_counts", """SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT props) AS kinds FROM events
 WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND event_type IN ('purchase', 'signup', 'click', 'view') GROUP BY 1""")
def e5(spark, d):
    e = table(spark, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-25'").filter(
        F.col("event_type").isin("purchase", "signup", "click", "view"))
    return e.groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("kinds")).orderBy(F.desc("events"))


# --- files and sinks -----------------------------------------------------------------------------

def fresh(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("S15_date_partitioned_write", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(*) AS rows FROM events GROUP BY 1")
def s15(spark, d):
    path = fresh(spark, "events-by-day")
    sinks.write_by_date(table(spark, d, "events"), path, "ts", "event_date")
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("rows"))


AUDIT_SQL = f"SELECT statement_id, {SEVERITY_SQL} AS severity, executed_by AS user_id FROM {SANITISED} WHERE is_suspicious"


def audit(spark, d):
    return protection.audit_entries(protection.sanitised_statements(history(spark, d)), "start_time", "executed_by", "warehouse_id")


@query("S10_audit_table_sink", AUDIT_SQL)
def s10(spark, d):
    path = fresh(spark, "audit")
    sinks.append_audit(audit(spark, d), path)
    return spark.read.parquet(path).select("statement_id", "severity", "user_id")


@query("S11_audit_json_sink", AUDIT_SQL)
def s11(spark, d):
    path = fresh(spark, "audit-json")
    sinks.append_json_lines(audit(spark, d), path)
    return spark.read.schema("statement_id string, severity string, user_id string").json(path)


ENTRY_SQL = f"""SELECT statement_id, start_time AS event_time, sha256(clean_text) AS query_hash, substr(clean_text, 1, 500) AS query_preview,
 array_to_string(hits, ' ; ') AS patterns_detected, {SEVERITY_SQL} AS severity, executed_by AS user_id, coalesce(warehouse_id, 'unknown') AS session_id FROM {SANITISED} WHERE is_suspicious"""


@query("S10_audit_table_entries", f"SELECT *, CAST(CAST(event_time AS DATE) AS VARCHAR) AS event_date FROM ({ENTRY_SQL})")
def s10_entries(spark, d):
    """All columns of the sink, and the day by which it is partitioned."""
    path = fresh(spark, "audit")
    sinks.append_audit(audit(spark, d), path)
    return spark.read.parquet(path).withColumns({
        "patterns_detected": F.array_join("patterns_detected", " ; "), "event_date": F.col("event_date").cast("string")})


@query("S11_audit_json_entries", ENTRY_SQL)
def s11_entries(spark, d):
    path, entries = fresh(spark, "audit-json"), audit(spark, d)
    sinks.append_json_lines(entries, path)
    return spark.read.schema(entries.schema).json(path).withColumn("patterns_detected", F.array_join("patterns_detected", " ; "))


@query("S15_date_partitioned_rows", "SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM events")
def s15_rows(spark, d):
    path = fresh(spark, "events-by-day")
    sinks.write_by_date(table(spark, d, "events"), path, "ts", "event_date")
    return spark.read.parquet(path).withColumn("event_date", F.col("event_date").cast("string"))


def file_key(name: str):
    return F.regexp_extract("path", f"{name}=([^/]+)/", 1)


def without_line_end(column: str):
    return F.expr(f"substr({column}, 1, length({column}) - 1)")


@query("S7_sql_files", f"SELECT md5(statement_text) AS digest, statement_text FROM (SELECT DISTINCT statement_text FROM {H} WHERE statement_text IS NOT NULL)")
def s7(spark, d):
    """Every distinct statement of the history as a file, read back from the folder."""
    path = fresh(spark, "statements")
    texts = history(spark, d).select("statement_text").distinct().withColumn("digest", F.md5("statement_text"))
    sinks.write_files(texts, path, "digest", "statement_text")
    return workspace.sql_files(spark, path, "*.txt").select(file_key("digest").alias("digest"), without_line_end("statement_text").alias("statement_text"))


GUIDE_BYTES = 4000


@query("S8_guideline_files", f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN bytes <= {GUIDE_BYTES} THEN markdown END AS markdown, CASE WHEN bytes > {GUIDE_BYTES} THEN bytes END AS skipped_bytes,
 CASE WHEN bytes > {GUIDE_BYTES} THEN 'larger than {GUIDE_BYTES} bytes' END AS reason FROM (SELECT *, CAST(strlen(markdown) + 1 AS BIGINT) AS bytes FROM {view_sql("guidelines")} WHERE markdown IS NOT NULL)""")
def s8(spark, d):
    """Every guide as a file, read back; those over the limit come as rows with a reason."""
    path = fresh(spark, "guides")
    sinks.write_files(view(spark, d, "guidelines").select("doc_id", "markdown"), path, "doc_id", "markdown")
    options = {"pattern": "*.txt", "max_bytes": GUIDE_BYTES}
    read = workspace.guideline_files(spark, path, **options).select(
        file_key("doc_id").cast("bigint").alias("doc_id"), without_line_end("markdown").alias("markdown"),
        F.lit(None).cast("bigint").alias("skipped_bytes"), F.lit(None).cast("string").alias("reason"))
    skipped = workspace.skipped_files(spark, path, **options).select(
        file_key("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("markdown"),
        F.col("bytes").alias("skipped_bytes"), "reason")
    return read.unionByName(skipped)


# --- context -------------------------------------------------------------------------------------

@query("K16_statement_context", f"""SELECT p.statement_id, concat_ws(chr(10), '<context>', CASE WHEN e.rule_key IS NOT NULL THEN concat('  <violations count="1">', chr(10), '    <violation n="1" rule="', e.rule_key, '" severity="', e.severity, '">', e.message, '</violation>', chr(10), '  </violations>') END,
 '  <performance>' || {PERF_SQL} || '</performance>', '  <duration_seconds>' || printf('%.1f', execution_duration_ms / 1000::DOUBLE) || '</duration_seconds>', '  <network>' || {NET_SQL} || '</network>', '  <io>' || {IO_SQL} || '</io>',
 CASE WHEN cluster_id IS NOT NULL THEN concat('  <cluster type="', node_type, '" executors="', executor_count, '" memory="', executor_memory, '" />') END,
 CASE WHEN {TABLES_CASE.replace('template_id', 'p.template_id')} <> '' THEN concat('  <tables>', {TABLES_CASE.replace('template_id', 'p.template_id')}, '</tables>') END, '</context>') AS context
 FROM ({PRICED_SQL}) p LEFT JOIN {values_sql(TEXTS)} e(template_id, rule_id, rule_key, severity, message, fix) ON p.template_id = e.template_id""")
def k16(spark, d):
    base = priced(spark, d)
    with_found = det.with_statements(base, violations(spark, d)).withColumn(
        "violations", F.coalesce("violations", F.array()))
    texts = governance.tables_by_text(history(spark, d))
    keyed = with_found.withColumn("text_key", text_key(F.col("statement_text")))
    return ctx.rendered(keyed.join(texts.withColumnRenamed("tables", "schemas"), "text_key", "left"))
