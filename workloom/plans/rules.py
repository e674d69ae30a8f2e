"""Rule-table processing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from workloom.operators import merge_store
from workloom.operators import rules as ops
from workloom.operators.ranking import latest_per_key
from workloom.plans.registry import query
from workloom.session import shared_folder
from workloom.sources.sinks import active_rules
from workloom.sources.workload import view, view_sql

R = view_sql("rules")
VALID_ID = "regexp_matches(rule_id, '^[A-Z]+_\\d{3}$')"
RANKED = f"(SELECT *, CASE source_name WHEN 'built-in' THEN 1 WHEN 'yaml' THEN 2 ELSE 3 END AS src FROM {R} WHERE {VALID_ID})"


def rules(spark, d):
    return view(spark, d, "rules")


def named_rules(spark, d):
    return rules(spark, d).filter(F.col("rule_id").rlike(r"^[A-Z]+_\d{3}$"))


@query("S9_active_rules", f"SELECT rule_id, config_version, severity, enabled, updated_at FROM {R} WHERE is_active")
def s9(spark, d):
    return active_rules(rules(spark, d)).select("rule_id", "config_version", "severity", "enabled", "updated_at")


@query("Q1_json_fields", f"""SELECT load_seq, CASE WHEN custom_thresholds LIKE '{{%}}' THEN 'max=' || json_extract_string(custom_thresholds, '$.max') ELSE '' END AS thresholds,
 CASE WHEN metadata LIKE '{{%}}' THEN CAST(json_extract_string(metadata, '$.confidence_score') AS DOUBLE) END AS confidence_score FROM {R}""")
def q1(spark, d):
    text = F.array_join(F.transform(F.map_entries("thresholds"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return ops.parse_json(rules(spark, d)).select("load_seq", text.alias("thresholds"), F.col("meta.confidence_score").alias("confidence_score"))


FILLED = f"""(SELECT *, coalesce(CASE WHEN metadata LIKE '{{%}}' THEN json_extract_string(metadata, '$.created_by') END, created_by) AS maker, coalesce(CASE WHEN metadata LIKE '{{%}}' THEN CAST(json_extract_string(metadata, '$.confidence_score') AS DOUBLE) END, 0.8::DOUBLE) AS confidence,
 CASE WHEN lower(detection_method) = 'ast_analysis' THEN 'AST' ELSE detection_method END AS method FROM {R})"""


@query("Q2_default_fill", f"""SELECT load_seq, maker AS created_by, updated_by AS approved_by, config_version AS version, confidence, coalesce(dependency, '') AS dependencies, method AS detection_method FROM {FILLED}""")
def q2(spark, d):
    return ops.fill_defaults(ops.parse_json(rules(spark, d))).select(
        "load_seq", "created_by", "approved_by", "version", "confidence", F.array_join("dependencies", ",").alias("dependencies"), "detection_method")


@query("Q3_validation", f"""SELECT load_seq, concat_ws(',', CASE WHEN NOT {VALID_ID} THEN 'rule_id' END, CASE WHEN length(name) NOT BETWEEN 10 AND 200 THEN 'name' END, CASE WHEN length(explanation) < 50 THEN 'explanation' END,
 CASE WHEN NOT regexp_matches(detector_class, '^[\\w.]+:[A-Z]\\w+$') THEN 'class' END, CASE WHEN NOT starts_with(split_part(detector_class, ':', 1) || '.', 'workloom.detectors.') THEN 'module' END,
 CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' END) AS reasons FROM {FILLED}""")
def q3(spark, d):
    return ops.validated(rules(spark, d)).select("load_seq", F.array_join("reasons", ",").alias("reasons"))


UPSERTED = f"""SELECT coalesce(t.rule_id, s.rule_id) AS rule_id, coalesce(t.config_version, s.config_version) AS config_version, CASE WHEN s.rule_id IS NULL THEN t.severity WHEN t.rule_id IS NULL OR t.severity IS DISTINCT FROM s.severity THEN s.severity ELSE t.severity END AS severity,
 CASE WHEN t.rule_id IS NULL THEN 'insert' WHEN s.rule_id IS NULL THEN 'keep' WHEN t.severity IS DISTINCT FROM s.severity THEN 'update' ELSE 'unchanged' END AS action
 FROM (SELECT * FROM {R} WHERE {VALID_ID} AND load_seq % 3 <> 0) t FULL OUTER JOIN (SELECT rule_id, config_version, CASE WHEN load_seq % 4 = 1 THEN 'low' ELSE severity END AS severity FROM {R} WHERE {VALID_ID} AND load_seq % 2 = 0) s
 ON t.rule_id = s.rule_id AND t.config_version = s.config_version"""


def upsert_sides(spark, d):
    """One row per rule and version on both sides of the upsert."""
    cols = ["rule_id", "config_version", "severity", "enabled", "updated_at", "load_seq"]
    every = named_rules(spark, d).select(*cols)
    one_each = lambda df: latest_per_key(df, ["rule_id", "config_version"], F.col("load_seq"))
    incoming = every.filter("load_seq % 2 = 0").withColumn("severity", F.when(F.col("load_seq") % 4 == 1, "low").otherwise(F.col("severity")))
    return one_each(every.filter("load_seq % 3 <> 0")), one_each(incoming)


@query("Q4_rule_upsert", UPSERTED)
def q4(spark, d):
    out = ops.upsert(*upsert_sides(spark, d))
    return out.select("rule_id", "config_version", "severity", "action")


@query("Q4_written_upsert", f"SELECT rule_id, config_version, severity, CASE WHEN action IN ('insert', 'update') THEN action ELSE 'same' END AS action FROM ({UPSERTED})")
def q4w(spark, d):
    """The rules as a merged table: files of rules without a change stay as they are."""
    path = f"{shared_folder(spark).rstrip('/')}/merged-rules-{uuid.uuid4().hex}"
    held, incoming = upsert_sides(spark, d)
    keys = ["rule_id", "config_version"]
    merge_store.create(held, path, keys, buckets=16)
    merge_store.merge_into(incoming, path, keys, ["severity", "enabled"])
    moved = merge_store.log(spark, path).select(*keys, "action")
    return merge_store.read(spark, path).join(moved, keys, "left").select(
        *keys, "severity", F.coalesce("action", F.lit("same")).alias("action"))


@query("W1_latest_rules", f"""SELECT rule_id, config_version, severity, load_seq FROM {R} WHERE is_active
 QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY config_version DESC, updated_at DESC, load_seq DESC) = 1""")
def w1(spark, d):
    return ops.latest_active(rules(spark, d)).select("rule_id", "config_version", "severity", "load_seq")


@query("W3_effective_rules", f"""SELECT rule_id, source_name, severity, enabled, load_seq FROM {RANKED} QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY src DESC, load_seq DESC) = 1""")
def w3(spark, d):
    r = named_rules(spark, d)
    return ops.effective(*[r.filter(F.col("source_name") == s) for s in ("built-in", "yaml", "table")]).select(
        "rule_id", "source_name", "severity", "enabled", "load_seq")


@query("U1_rule_sources", f"SELECT rule_id, source_name, load_seq FROM {R}")
def u1(spark, d):
    from workloom.operators.rewrites import union_all

    r = rules(spark, d)
    return union_all(*[r.filter(F.col("source_name") == s) for s in ("built-in", "yaml", "table")]).select("rule_id", "source_name", "load_seq")


@query("W4_override_history", f"SELECT rule_id, string_agg(source_name, ' > ' ORDER BY src, load_seq) AS history, arg_max(source_name, src::BIGINT * 1000000000 + load_seq) AS effective_source FROM {RANKED} GROUP BY 1")
def w4(spark, d):
    return ops.override_history(named_rules(spark, d)).withColumn("history", F.array_join("history", " > "))


@query("W4_changed_fields", f"""SELECT rule_id, load_seq, concat_ws(',', CASE WHEN severity IS DISTINCT FROM p1 THEN 'severity' END, CASE WHEN enabled IS DISTINCT FROM p2 THEN 'enabled' END,
 CASE WHEN custom_thresholds IS DISTINCT FROM p3 THEN 'custom_thresholds' END, CASE WHEN custom_message IS DISTINCT FROM p4 THEN 'custom_message' END) AS changes FROM (
 SELECT *, lag(severity) OVER w AS p1, lag(enabled) OVER w AS p2, lag(custom_thresholds) OVER w AS p3, lag(custom_message) OVER w AS p4, row_number() OVER w AS rn FROM {RANKED} WINDOW w AS (PARTITION BY rule_id ORDER BY src, load_seq)) WHERE rn > 1""")
def w4c(spark, d):
    return ops.changed_fields(named_rules(spark, d), bucket_rows=2).select("rule_id", "load_seq", F.array_join("changes", ",").alias("changes"))


@query("A10_override_stats", f"""SELECT count(*) AS total_rules, count(*) FILTER (n > 1) AS overridden_rules, (SELECT string_agg(DISTINCT source_name, ', ' ORDER BY source_name) FROM {R}) AS sources_used
 FROM (SELECT rule_id, count(*) AS n FROM {R} GROUP BY 1)""")
def a10(spark, d):
    return ops.override_stats(rules(spark, d))
