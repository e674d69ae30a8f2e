"""Catalog governance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from workloom.functions.lexical import text_key
from workloom.functions.names import full_table_name, is_system_table
from workloom.operators import governance as ops
from workloom.operators import merge_store
from workloom.operators.rewrites import union_distinct
from workloom.plans.history import H, history
from workloom.plans.registry import query
from workloom.session import shared_folder
from workloom.sources import workspace as ws
from workloom.sources.tables import table
from workloom.sources.workload import view, view_sql

COLS = view_sql("columns")
TAGS = view_sql("tags")


def contains_any(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


PII_SQL = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {contains_any('lower(column_name)', parts)} OR {contains_any(chr(99) + 'oalesce(lower(column_comment), ' + repr('') + ')', parts)} THEN '{cls}' END"
    for cls, parts in ops.PII_CLASSES) + ")"
COMPLIANCE_SQL = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {contains_any('lower(table_comment)', words)} THEN '{tag}' END" for tag, words in ops.COMPLIANCE) + ")"
CLASSIFIED = f"(SELECT *, {PII_SQL} AS pii, {COMPLIANCE_SQL} AS security_tags FROM {COLS})"


def columns(spark, d):
    return view(spark, d, "columns")


@query("G1_pii_columns", f"SELECT table_name, column_name, ordinal_position, pii FROM {CLASSIFIED}")
def g1(spark, d):
    return ops.classified(columns(spark, d)).select("table_name", "column_name", "ordinal_position", F.array_join("pii", ", ").alias("pii"))


@query("G2_compliance_tags", f"SELECT table_name, max(security_tags) AS security_tags FROM {CLASSIFIED} GROUP BY 1")
def g2(spark, d):
    per_table = columns(spark, d).groupBy("table_name").agg(F.max("table_comment").alias("c"))
    return per_table.select("table_name", F.array_join(ops.compliance_tags(F.col("c")), ", ").alias("security_tags"))


INDICATORS = f"(SELECT table_name, string_agg(DISTINCT p, ', ' ORDER BY p) AS pii_indicators FROM (SELECT table_name, unnest(string_split(pii, ', ')) AS p FROM {CLASSIFIED} WHERE pii <> '') GROUP BY 1)"


@query("A13_pii_summary", f"SELECT c.table_name, coalesce(max(i.pii_indicators), '') AS pii_indicators, max(c.security_tags) AS security_tags FROM {CLASSIFIED} c LEFT JOIN {INDICATORS} i ON c.table_name = i.table_name GROUP BY 1")
def a13(spark, d):
    return ops.pii_summary(columns(spark, d)).select(
        "table_name", F.array_join("pii_indicators", ", ").alias("pii_indicators"), F.array_join("security_tags", ", ").alias("security_tags"))


def documents(spark, d):
    tags = view(spark, d, "tags")
    return ops.table_documents(
        columns(spark, d), ws.tag_maps(tags.filter("column_name IS NULL"), "table_name"),
        ws.tag_maps(tags.filter("column_name IS NOT NULL"), "table_name", "column_name"))


TAG_SQL = "(SELECT table_name, {extra} string_agg(tag_name || '=' || tag_value, ', ' ORDER BY tag_name) AS tags FROM (SELECT table_name, {extra} tag_name, arg_max(tag_value, applied_seq) AS tag_value FROM {src} WHERE {cond} GROUP BY ALL) GROUP BY ALL)"
TABLE_TAGS = TAG_SQL.format(extra="", src=TAGS, cond="column_name IS NULL")
COLUMN_TAGS = TAG_SQL.format(extra="column_name,", src=TAGS, cond="column_name IS NOT NULL")
DOC_SQL = f"""(SELECT c.table_name, max(c.table_comment) AS table_comment, count(*) AS n_columns, max(c.security_tags) AS security_tags, max(i.pii_indicators) AS pii_indicators, max(t.tags) AS table_tags,
 string_agg(c.column_name || ':' || c.data_type || coalesce('[' || k.tags || ']', ''), ', ' ORDER BY c.ordinal_position, c.column_name) AS columns_text,
 string_agg(CASE WHEN k.tags IS NOT NULL THEN '    - ' || c.column_name || ' (' || c.data_type || '): ' || k.tags END, chr(10) ORDER BY c.ordinal_position, c.column_name) AS tagged_text
 FROM {CLASSIFIED} c LEFT JOIN {INDICATORS} i ON c.table_name = i.table_name LEFT JOIN {TABLE_TAGS} t ON c.table_name = t.table_name LEFT JOIN {COLUMN_TAGS} k ON c.table_name = k.table_name AND c.column_name = k.column_name GROUP BY 1)"""


@query("G3_table_documents", f"SELECT table_name, table_comment, n_columns, security_tags, coalesce(pii_indicators, '') AS pii_indicators, coalesce(table_tags, '') AS table_tags, columns_text FROM {DOC_SQL}")
def g3(spark, d):
    text = F.transform("columns", lambda c: F.concat(
        c["name"], F.lit(":"), c["type"],
        F.when(F.size(c["column_tags"]) > 0, F.concat(F.lit("["), ops.tag_list(c["column_tags"]), F.lit("]"))).otherwise("")))
    return documents(spark, d).select(
        "table_name", "table_comment", F.size("columns").alias("n_columns"), F.array_join("security_tags", ", ").alias("security_tags"),
        F.array_join("pii_indicators", ", ").alias("pii_indicators"), ops.tag_list(F.col("table_tags")).alias("table_tags"),
        F.array_join(text, ", ").alias("columns_text"))


@query("G4_markdown_documents", f"""SELECT table_name, concat_ws(chr(10), '- **' || table_name || '**', '  - Description: ' || table_comment, '  - Tags: ' || table_tags, '  - PII Detected: ' || pii_indicators,
 CASE WHEN security_tags <> '' THEN '  - Compliance: ' || security_tags END, '  - Columns: ' || n_columns, tagged_text) AS document FROM {DOC_SQL}""")
def g4(spark, d):
    return ops.markdown_document(documents(spark, d))


@query("G4_xml_documents", f"""SELECT table_name, concat_ws(chr(10), '<table name="' || table_name || '">', CASE WHEN max(security_tags) <> '' THEN '  <compliance_tags>' || max(security_tags) || '</compliance_tags>' END, '  <columns count="' || max(total) || '">',
 string_agg(element, chr(10) ORDER BY pii = '', rn, more DESC), '  </columns>' || chr(10) || '</table>') AS document FROM (
 SELECT table_name, security_tags, total, pii, rn, 0 AS more, '    <column name="' || column_name || '" type="' || data_type || '" ' || CASE WHEN is_nullable = 'YES' THEN 'nullable' ELSE 'required' END ||
  CASE WHEN pii <> '' THEN ' pii="' || pii || '">Sensitive</column>' WHEN column_comment IS NOT NULL THEN '>' || replace(replace(column_comment, '<', '&lt;'), '>', '&gt;') || '</column>' ELSE ' />' END AS element, n
 FROM (SELECT *, row_number() OVER (PARTITION BY table_name, pii = '' ORDER BY ordinal_position, column_name) AS rn, count(*) OVER (PARTITION BY table_name, pii = '') AS n, count(*) OVER (PARTITION BY table_name) AS total FROM {CLASSIFIED})
 WHERE pii <> '' OR n <= 10 OR rn <= 5 OR rn > n - 5
 UNION ALL SELECT table_name, max(security_tags), max(total), '', 6, 1, '    <!-- ... ' || (count(*) - 10) || ' more columns ... -->', count(*) FROM (SELECT *, count(*) OVER (PARTITION BY table_name) AS total FROM {CLASSIFIED}) WHERE pii = '' GROUP BY table_name HAVING count(*) > 10) GROUP BY table_name""")
def g4x(spark, d):
    return ops.xml_document(documents(spark, d))


@query("G5_tag_upsert", f"""SELECT coalesce(t.table_name, s.table_name) AS table_name, coalesce(t.tag_name, s.tag_name) AS tag_name, CASE WHEN s.table_name IS NULL OR t.tag_value = s.tag_value THEN t.tag_value ELSE s.tag_value END AS tag_value,
 CASE WHEN t.table_name IS NULL THEN 'insert' WHEN s.table_name IS NULL THEN 'keep' WHEN t.tag_value <> s.tag_value THEN 'update' ELSE 'unchanged' END AS action
 FROM (SELECT table_name, tag_name, arg_max(tag_value, applied_seq) AS tag_value FROM {TAGS} WHERE applied_seq % 3 <> 0 GROUP BY ALL) t FULL OUTER JOIN
 (SELECT table_name, tag_name, arg_max(tag_value, applied_seq) AS tag_value FROM {TAGS} WHERE applied_seq % 2 = 0 GROUP BY ALL) s ON t.table_name = s.table_name AND t.tag_name = s.tag_name""")
def g5(spark, d):
    tags = view(spark, d, "tags")
    return ops.assign_tags(
        ws.latest_tags(tags.filter("applied_seq % 3 <> 0"), "table_name"),
        ws.latest_tags(tags.filter("applied_seq % 2 = 0"), "table_name"), ["table_name", "tag_name"])


@query("G5_written_tags", f"SELECT table_name, tag_name, arg_max(tag_value, rank) AS tag_value FROM (SELECT table_name, tag_name, tag_value, applied_seq + CASE WHEN applied_seq % 2 = 0 THEN 1000000000000 ELSE 0 END AS rank FROM {TAGS} WHERE applied_seq % 3 <> 0 OR applied_seq % 2 = 0) GROUP BY ALL")
def g5w(spark, d):
    """Tags as a merged table, read back after the bulk upsert."""
    path = f"{shared_folder(spark).rstrip('/')}/merged-tags-{uuid.uuid4().hex}"
    tags, keys = view(spark, d, "tags"), ["table_name", "tag_name"]
    merge_store.create(ws.latest_tags(tags.filter("applied_seq % 3 <> 0"), "table_name"), path, keys, buckets=16)
    merge_store.merge_into(ws.latest_tags(tags.filter("applied_seq % 2 = 0"), "table_name"), path, keys, ["tag_value"])
    return merge_store.read(spark, path).select(*keys, "tag_value")


# Full table names a reader finds in each statement template.
TABLES_OF = {
    **{i: "main.sales.orders" for i in (0, 2, 8, 12, 23)}, 1: "main.sales.lineitem",
    **{i: "main.sales.customer, main.sales.orders" for i in (3, 5, 20)},
    **{i: "main.web.events" for i in (6, 7, 9, 15)}, 11: "main.sales.customer",
}
TABLES_CASE = "CASE template_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in TABLES_OF.items()) + " ELSE '' END"


@query("G6_statement_tables", f"SELECT statement_id, {TABLES_CASE} AS tables FROM {H}")
def g6(spark, d):
    h = history(spark, d)
    found = ops.tables_by_text(h).select("text_key", F.array_join("tables", ", ").alias("tables"))
    return h.select("statement_id", text_key(F.col("statement_text")).alias("text_key")).join(found, "text_key").drop("text_key")


NAMES = "SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'web.' WHEN 2 THEN 'prod.web.' WHEN 3 THEN 'system.a.' ELSE 'a.b.c.' END, lower(replace(p_brand, '#', '_'))) AS table_name FROM {part}"


@query("G7_normalised_names", f"""SELECT p_partkey, CASE len(string_split(table_name, '.')) WHEN 3 THEN table_name WHEN 2 THEN 'main.' || table_name WHEN 1 THEN 'main.default.' || table_name END AS full_name FROM ({NAMES.format(part='part')})""")
def g7(spark, d):
    return spark.sql(NAMES, part=table(spark, d, "part")).select("p_partkey", full_table_name(F.col("table_name")).alias("full_name"))


@query("G8_user_tables", f"SELECT p_partkey, table_name FROM ({NAMES.format(part='part')}) WHERE NOT starts_with(table_name, 'system.')")
def g8(spark, d):
    return spark.sql(NAMES, part=table(spark, d, "part")).filter(~is_system_table(F.col("table_name")))


@query("G9_table_usage", f"""SELECT table_name, count(*) AS statements, count(DISTINCT executed_by) AS users FROM (SELECT executed_by, unnest(string_split({TABLES_CASE}, ', ')) AS table_name FROM {H}) WHERE table_name <> '' GROUP BY 1""")
def g9(spark, d):
    return ops.table_usage(history(spark, d))


def problem(name, parts_max=3):
    return f"""CASE WHEN len(string_split({name}, '.')) > {parts_max} THEN 'more than three parts' WHEN NOT regexp_matches({name}, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 'invalid characters'
 WHEN lower({name}) IN ('select', 'from', 'where') THEN 'reserved word' END"""


@query("G10_name_audit", f"SELECT table_name, column_name, {problem('column_name')} AS column_problem, 'more than three parts' AS path_problem FROM {COLS}")
def g10(spark, d):
    return ops.name_audit(columns(spark, d))


CATALOG = f"(SELECT CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'main.sales.orders' WHEN 1 THEN 'main.sales.customer' WHEN 2 THEN 'main.web.events' ELSE 'main.other.t' END AS table_name, count(*) AS doc_rows FROM orders GROUP BY 1)"


@query("J6_statement_schemas", f"""SELECT s.statement_id, c.table_name, c.doc_rows FROM (SELECT statement_id, unnest(string_split({TABLES_CASE}, ', ')) AS table_name FROM {H}) s JOIN {CATALOG} c ON s.table_name = c.table_name""")
def j6(spark, d):
    name = F.when(F.col("o_custkey") % 4 == 0, "main.sales.orders").when(F.col("o_custkey") % 4 == 1, "main.sales.customer").when(
        F.col("o_custkey") % 4 == 2, "main.web.events").otherwise("main.other.t")
    catalog = table(spark, d, "orders").groupBy(name.alias("table_name")).agg(F.count("*").alias("doc_rows"))
    return ops.statement_schemas(history(spark, d), catalog).select("statement_id", "table_name", "doc_rows")


@query("W8_condensed_columns", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY table_name, pii <> '' ORDER BY ordinal_position, column_name) AS rn, count(*) OVER (PARTITION BY table_name, pii <> '') AS n FROM {CLASSIFIED})
SELECT table_name, pii <> '' AS is_pii, rn AS position, column_name AS entry FROM r WHERE pii <> '' OR n <= 10 OR rn <= 5 OR rn > n - 5
UNION ALL SELECT table_name, FALSE, 6, '... ' || (n - 10) || ' more' FROM r WHERE pii = '' AND n > 10 AND rn = 6""")
def w8(spark, d):
    return ops.condensed_columns(columns(spark, d))


@query("U2_statement_set", f"SELECT DISTINCT statement_text FROM {H} WHERE event_id % 2 = 0 UNION SELECT statement_text FROM {H} WHERE event_id % 3 = 0")
def u2(spark, d):
    h = history(spark, d)
    return union_distinct(h.filter("event_id % 2 = 0").select("statement_text"), h.filter("event_id % 3 = 0").select("statement_text"))


@query("U3_set_difference", f"SELECT table_name FROM {COLS} EXCEPT SELECT table_name FROM {TAGS}")
def u3(spark, d):
    left = columns(spark, d).select("table_name").distinct()
    return left.join(view(spark, d, "tags").select("table_name").distinct(), "table_name", "left_anti")


@query("U4_set_intersection", f"SELECT table_name FROM {COLS} INTERSECT SELECT table_name FROM {TAGS}")
def u4(spark, d):
    left = columns(spark, d).select("table_name").distinct()
    return left.join(view(spark, d, "tags").select("table_name").distinct(), "table_name", "left_semi")
