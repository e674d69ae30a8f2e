"""Guideline retrieval, compression, coverage of violations by recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from workloom.functions.formats import rounded, rounded_sql
from workloom.functions.lexical import text_key
from workloom.operators import budget, governance, retrieval as ops
from workloom.operators import detectors as det
from workloom.operators import statement_sections as sections
from workloom.operators.ranking import spread_by, top_k
from workloom.operators.vector_index import cosine_top_k
from workloom.plans.detection import expected_sql, violations
from workloom.plans.governance import TABLES_CASE
from workloom.plans.history import H, history
from workloom.plans.registry import query
from workloom.session import written
from workloom.sources.tables import table, widened
from workloom.sources.workload import view, view_sql

GL = view_sql("guidelines")
LINES = f"""(SELECT doc_id, line_no, line, sum(CASE WHEN regexp_matches(line, '^##\\s+\\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no
 FROM (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS line_no FROM {GL}))"""
SECTIONS = f"""(SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, trim(regexp_replace(max(CASE WHEN regexp_matches(line, '^##\\s+\\S') THEN line END), '^##\\s+', '')) AS heading,
 coalesce(string_agg(CASE WHEN NOT regexp_matches(line, '^##\\s+\\S') AND NOT regexp_matches(line, '^#\\s+.+$') THEN line END, chr(10) ORDER BY line_no), '') AS content,
 CAST(min(line_no) AS BIGINT) AS line_start, CAST(max(line_no) AS BIGINT) AS line_end FROM {LINES} WHERE section_no > 0 GROUP BY doc_id, section_no)"""
FENCE = "```"
BLOCKS = f"list_filter(list_transform(regexp_extract_all(content, '(?si){FENCE}(?:sql)?\\s*\\n(.*?)\\n{FENCE}', 1), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')), lambda b: b <> '')"
WORDS = "list_filter([" + ", ".join(f"CASE WHEN contains(upper(heading), '{w}') OR contains(upper(content), '{w}') THEN '{w}' END" for w in sorted(ops.PRIORITY_WORDS)) + "], lambda w: w IS NOT NULL)"
DESCRIBED = f"""(SELECT *, CASE WHEN list_has_any(words, {list(ops.TOP_WORDS)}) THEN 10 WHEN list_has_any(words, {list(ops.HIGH_WORDS)}) THEN 20 ELSE 40 END AS priority,
 list_sort(list_distinct(list_transform(flatten(list_transform(code_blocks, lambda b: regexp_extract_all(b, '(?i)\\b(?:FROM|JOIN|INTO|TABLE)\\s+([a-z_][a-z0-9_]*(?:\\.[a-z_][a-z0-9_]*)*)', 1))), lambda t: lower(t)))) AS affected_tables,
 length(content) // 4 AS tokens FROM (SELECT *, {WORDS} AS words, {BLOCKS} AS code_blocks FROM {SECTIONS}))"""
QUERY_TABLES = ["main.sales.Orders", "main.web.t3"]
SCORED = f"""(SELECT d.*, docs.source, list_has_any(affected_tables, ['main.sales.orders', 'main.web.t3']) AS table_overlap,
 priority - CASE WHEN list_has_any(affected_tables, ['main.sales.orders', 'main.web.t3']) THEN 15 ELSE 0 END - CASE WHEN len(code_blocks) > 0 THEN 5 ELSE 0 END AS score
 FROM {DESCRIBED} d JOIN documents docs ON d.doc_id = docs.doc_id)"""


def guidelines(spark, d):
    return widened(view(spark, d, "guidelines"))


def described(spark, d):
    return ops.described(ops.sections(guidelines(spark, d)))


def scored(spark, d):
    """Sections with their relevance and the source of their document."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return ops.relevance(described(spark, d), QUERY_TABLES).join(docs, "doc_id")


@query("K1_sections", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no) AS n, heading, content, line_start, line_end FROM {SECTIONS}")
def k1(spark, d):
    """A document opens with a title line, so its first section has position one."""
    return ops.sections(guidelines(spark, d)).select(
        "doc_id", F.col("section_no").cast("bigint").alias("n"), "heading", "content",
        F.col("line_start").cast("bigint").alias("line_start"), F.col("line_end").cast("bigint").alias("line_end"))


@query("K2_code_blocks", f"SELECT doc_id, line_start, array_to_string(code_blocks, '||') AS code_blocks, array_to_string(affected_tables, ', ') AS affected_tables FROM {DESCRIBED}")
def k2(spark, d):
    return described(spark, d).select(
        "doc_id", "line_start", F.array_join("code_blocks", "||").alias("code_blocks"), F.array_join("affected_tables", ", ").alias("affected_tables"))


@query("K3_priority", f"SELECT doc_id, line_start, array_to_string(words, ', ') AS words, priority FROM {DESCRIBED}")
def k3(spark, d):
    return described(spark, d).select("doc_id", "line_start", F.array_join("words", ", ").alias("words"), "priority")


@query("K4_token_truncation", """SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) <= 800 THEN text ELSE substr(text, 1, 800) || chr(10) || chr(10) || '[Content truncated at 200 tokens]' END AS shown FROM documents""")
def k4(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", ops.tokens(F.col("text")).alias("tokens"), ops.truncated(F.col("text"), 200).alias("shown"))


@query("K5_relevance", f"SELECT doc_id, line_start, score FROM {SCORED}")
def k5(spark, d):
    return scored(spark, d).select("doc_id", "line_start", "score")


@query("J10_table_overlap", f"SELECT doc_id, line_start, table_overlap FROM {SCORED}")
def j10(spark, d):
    return scored(spark, d).select("doc_id", "line_start", "table_overlap")


REDUCE = """list_reduce(list_prepend({'used': 0::BIGINT, 'ids': []::BIGINT[]}, list({'used': tokens::BIGINT, 'ids': [doc_id * 1000000000 + line_start]::BIGINT[]} ORDER BY score, doc_id, line_start)),
 lambda a, x: CASE WHEN a.used + x.used <= BUDGET THEN {'used': a.used + x.used, 'ids': list_concat(a.ids, x.ids)} ELSE a END)"""
PASS1 = f"(SELECT source, r.used AS used, r.ids AS ids FROM (SELECT source, {REDUCE} AS r FROM {SCORED} WHERE priority <= 10 GROUP BY source))"


@query("W7_budget_skip", f"SELECT source, unnest(ids) AS row_key FROM {PASS1.replace('BUDGET', '2000')}")
def w7(spark, d):
    """Critical sections per source that fit into 2000 tokens, skipping those that do not."""
    # The choice reads the sections three times; they are written once, without the texts.
    s = written(scored(spark, d).filter("priority <= 10").select("source", "doc_id", "line_start", "score", "tokens"))
    out = budget.take_what_fits(s, ["source"], F.struct("score", "doc_id", "line_start"), "tokens", ["doc_id", "line_start"], 2000)
    return out.select("source", (F.col("doc_id") * 1_000_000_000 + F.col("line_start")).alias("row_key"))


@query("W6_budget_stop", f"""SELECT source, doc_id, line_start FROM (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY score, doc_id, line_start) AS s FROM {SCORED}) WHERE s <= 2000""")
def w6(spark, d):
    s = written(scored(spark, d).select("source", "doc_id", "line_start", "score", "tokens"))
    out = budget.take_until_overflow(
        s, ["source"], F.struct("score", "doc_id", "line_start"), "tokens", ["doc_id", "line_start"], 2000)
    return out.select("source", "doc_id", "line_start")


@query("K6_selected_sections", f"""WITH s AS {SCORED}, p AS {PASS1.replace('BUDGET', '2000').replace(SCORED, 's')}, one AS (SELECT source, used, unnest(ids) AS row_key FROM p)
SELECT source, row_key, 1 AS pass FROM one UNION ALL SELECT source, row_key, 2 FROM (
 SELECT s.source, s.doc_id * 1000000000 + s.line_start AS row_key, sum(s.tokens) OVER (PARTITION BY s.source ORDER BY s.score, s.doc_id, s.line_start) + coalesce(p.used, 0) AS total FROM s LEFT JOIN p ON s.source = p.source
 WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.row_key = s.doc_id * 1000000000 + s.line_start)) WHERE total <= 2000""")
def k6(spark, d):
    out = ops.select_sections(scored(spark, d), ["source"], ["doc_id", "line_start"])
    return out.select("source", (F.col("doc_id") * 1_000_000_000 + F.col("line_start")).alias("row_key"), "pass")


# --- sections for the statement at hand ------------------------------------------------------------

SETS = f"(SELECT tables, count(*) AS statements FROM (SELECT list_sort(list_distinct(string_split(lower({TABLES_CASE}), ', '))) AS tables FROM {H}) GROUP BY tables)"
FOR_SETS = f"""(SELECT array_to_string(t.tables, ', ') AS tables, t.statements, d.doc_id, d.line_start, d.priority, d.tokens, list_has_any(d.affected_tables, t.tables) AS shared,
 d.priority - CASE WHEN list_has_any(d.affected_tables, t.tables) THEN 15 ELSE 0 END - CASE WHEN len(d.code_blocks) > 0 THEN 5 ELSE 0 END AS score
 FROM {DESCRIBED} d, {SETS} t)"""


def table_sets(spark, d):
    h = history(spark, d)
    return sections.table_sets(h, governance.tables_by_text(h), text_key(F.col("statement_text")))


@query("J10_statement_overlap", f"SELECT tables, doc_id, line_start, score FROM {FOR_SETS} WHERE shared")
def j10_statements(spark, d):
    """Sections that share a table with a statement, and their scores, per distinct set of tables."""
    rows = ["doc_id", "line_start"]
    found = sections.overlaps(table_sets(spark, d), sections.scored_sections(described(spark, d), rows), rows)
    return found.select(F.array_join("tables", ", ").alias("tables"), "doc_id", "line_start", "score")


CHOSEN = """list_reduce(list_prepend({'used': 0::BIGINT, 'ids': []::VARCHAR[]}, list({'used': tokens::BIGINT, 'ids': [concat(doc_id, ':', line_start)]::VARCHAR[]} ORDER BY score, doc_id, line_start)),
 lambda a, x: CASE WHEN a.used + x.used <= 2000 THEN {'used': a.used + x.used, 'ids': list_concat(a.ids, x.ids)} ELSE a END)"""


@query("K6_statement_sections", f"""WITH s AS (SELECT * FROM {FOR_SETS} WHERE tokens > 0),
 p AS (SELECT tables, r.used AS used, r.ids AS ids FROM (SELECT tables, {CHOSEN} AS r FROM s WHERE priority <= 10 GROUP BY tables)),
 m AS (SELECT s.*, coalesce(p.used, 0) AS used, coalesce(list_contains(p.ids, concat(doc_id, ':', line_start)), false) AS first FROM s LEFT JOIN p ON s.tables = p.tables)
SELECT tables, statements, doc_id, line_start, 1 AS pass FROM m WHERE first UNION ALL SELECT tables, statements, doc_id, line_start, 2 FROM (
 SELECT *, used + sum(tokens) OVER (PARTITION BY tables ORDER BY score, doc_id, line_start) AS total FROM m WHERE NOT first) WHERE total <= 2000""")
def k6_statements(spark, d):
    """The sections each set of tables gets under a budget of 2000 tokens, and how many statements name that set."""
    found = sections.sections_for_statements(described(spark, d), table_sets(spark, d), ["doc_id", "line_start"])
    return found.withColumn("tables", F.array_join("tables", ", "))


@query("A9_guideline_stats", f"""SELECT count(*) AS total_sections, count(*) FILTER (priority <= 10) AS critical_sections, count(*) FILTER (priority > 10 AND priority <= 20) AS high_sections, count(*) FILTER (priority > 20 AND priority <= 30) AS medium_sections,
 CAST(sum(len(code_blocks)) AS BIGINT) AS total_code_blocks, CAST(sum(tokens) AS BIGINT) AS total_tokens, count(DISTINCT doc_id) AS files_loaded,
 (SELECT count(DISTINCT t) FROM (SELECT unnest(affected_tables) AS t FROM {DESCRIBED})) AS unique_tables FROM {DESCRIBED}""")
def a9(spark, d):
    return ops.guideline_stats(described(spark, d), "doc_id")


@query("W10_top_headings", f"""SELECT doc_id, line_start, heading, CASE WHEN priority <= 10 THEN 'CRITICAL' WHEN priority <= 20 THEN 'HIGH' ELSE 'MEDIUM' END AS band FROM {DESCRIBED} ORDER BY priority, doc_id, line_start LIMIT 10""")
def w10(spark, d):
    return ops.top_headings(described(spark, d), ["doc_id", "line_start"])


@query("W9_top_sections", f"SELECT source, doc_id, line_start, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, doc_id, line_start) AS rn FROM {SCORED}) WHERE rn <= 3")
def w9(spark, d):
    return top_k(scored(spark, d), ["source"], [F.col("score"), F.col("doc_id"), F.col("line_start")], 3, spread_by("doc_id")).select(
        "source", "doc_id", "line_start", "rn")


# --- classification and keywords over detected violations --------------------------------------

KEYS = ["UNION_NO_ALL", "CARTESIAN_JOIN", "SELECT_STAR", "IMPLICIT_CAST", "NOT_IN_NULLS"]
CLASS_OF = {"UNION_NO_ALL": "efficiency", "CARTESIAN_JOIN": "efficiency", "SELECT_STAR": "efficiency"}
CLASS_CASE = "CASE rule_key " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASS_OF.items()) + " ELSE 'general' END"


@query("K7_violation_class", f"SELECT statement_id, rule_key, {CLASS_CASE} AS cls FROM ({expected_sql(KEYS)})")
def k7(spark, d):
    return violations(spark, d, KEYS).select("statement_id", "rule_key", ops.violation_class(F.col("rule_key")).alias("cls"))


EFFICIENCY = "['shuffle', 'scan', 'bytes', 'network', 'io', 'data']"


@query("K8_keywords", f"""SELECT statement_id, array_to_string(list_sort(list_distinct(list_concat(string_split(lower(replace(rule_key, '_', ' ')), ' '), CASE WHEN {CLASS_CASE} = 'efficiency' THEN {EFFICIENCY} ELSE [] END))), ' ') AS words FROM ({expected_sql(KEYS)})""")
def k8(spark, d):
    cls = ops.violation_class(F.col("rule_key"))
    return violations(spark, d, KEYS).select("statement_id", F.array_join(ops.keywords(F.col("rule_key"), cls), " ").alias("words"))


# --- text splitting and scoring over the guideline corpus ---------------------------------------

PATTERN = "CASE doc_id % 5 WHEN 0 THEN 'slow_shuffle' WHEN 1 THEN 'MEMORY_detail' WHEN 2 THEN 'select_star' WHEN 3 THEN 'gdpr_notes' ELSE 'odd_thing' END"
CLS = "CASE doc_id % 5 WHEN 0 THEN 'performance' WHEN 1 THEN 'resource' WHEN 2 THEN 'efficiency' WHEN 3 THEN 'security' ELSE 'general' END"


def words_case():
    arms = []
    for i, (own, cls) in enumerate((("slow shuffle", "performance"), ("memory detail", "resource"), ("select star", "efficiency"), ("gdpr notes", "security"), ("odd thing", None))):
        arms.append(f"WHEN {i} THEN {sorted(set(own.split()) | set(ops.CLASS_WORDS.get(cls, ())))}")
    return "CASE doc_id % 5 " + " ".join(arms) + " END"


TEXTS = f"(SELECT doc_id, markdown, {CLS} AS cls, {words_case()} AS words, list_filter(list_transform(string_split_regex(regexp_replace(markdown, '(?m)^[ \\t\\r]+|[ \\t\\r]+$', '', 'g'), '\\n{{2,}}'), lambda p: regexp_replace(p, '^\\n+|\\n+$', '', 'g')), lambda p: p <> '') AS paras FROM {GL})".replace("{{2,}}", "{2,}")
PARAS = f"(SELECT doc_id, markdown, cls, words, unnest(paras) AS para FROM {TEXTS})"
PARA_SCORE = "CAST(list_sum(list_transform(words, lambda w: (length(lower(para)) - length(replace(lower(para), w, ''))) // length(w))) AS BIGINT) * CASE WHEN contains(lower(para), cls) THEN 2 ELSE 1 END"


def patterned(spark, d):
    g = guidelines(spark, d).withColumn("pattern", F.expr(PATTERN))
    g = g.withColumn("cls", ops.violation_class(F.col("pattern")))
    return g.withColumn("words", ops.keywords(F.col("pattern"), F.col("cls")))


@query("K9_paragraphs", f"SELECT doc_id, para FROM {PARAS}")
def k9(spark, d):
    return guidelines(spark, d).select("doc_id", F.explode_outer(ops.paragraphs(F.col("markdown"))).alias("para"))


BLOCK_SQL = f"""(SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY line_no), ' ' || chr(10) || chr(9)) AS block, b FROM (SELECT *, sum(CASE WHEN regexp_matches(line, '^#+(\\s|$)') AND line_no > 0 AND regexp_matches(line, '^#+\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM {LINES}) GROUP BY doc_id, b)"""


@query("K9_header_blocks", f"SELECT doc_id, block FROM {BLOCK_SQL} WHERE block <> ''")
def k9h(spark, d):
    return guidelines(spark, d).select("doc_id", F.explode_outer(ops.header_blocks(F.col("markdown"))).alias("block"))


@query("K10_section_scores", f"SELECT doc_id, para, {PARA_SCORE} AS score FROM {PARAS}")
def k10(spark, d):
    p = patterned(spark, d).select("doc_id", "words", "cls", F.explode_outer(ops.paragraphs(F.col("markdown"))).alias("para"))
    return p.select("doc_id", "para", ops.section_score(F.col("para"), F.col("words"), F.col("cls")).alias("score"))


CONTEXT_SQL = f"""(SELECT m.doc_id, coalesce(f.txt, substr(m.markdown, 1, 500)) AS small FROM {GL} m LEFT JOIN (SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY score DESC, para DESC) AS txt FROM (
 SELECT *, sum(length(para) // 4) OVER (PARTITION BY doc_id ORDER BY score DESC, para DESC ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT doc_id, para, {PARA_SCORE} AS score FROM {PARAS}) WHERE score > 0) WHERE used <= 250 GROUP BY doc_id) f ON m.doc_id = f.doc_id)"""


@query("K11_filtered_context", f"SELECT doc_id, small FROM {CONTEXT_SQL}")
def k11(spark, d):
    return patterned(spark, d).select("doc_id", ops.filtered_context(F.col("markdown"), F.col("words"), F.col("cls")).alias("small"))


TOP_SQL = f"""(SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY hits DESC, block DESC) AS small FROM (SELECT b.doc_id, block, len(list_filter(words, lambda w: contains(lower(block), w))) AS hits,
 row_number() OVER (PARTITION BY b.doc_id ORDER BY len(list_filter(words, lambda w: contains(lower(block), w))) DESC, block DESC) AS rn FROM {BLOCK_SQL} b JOIN {TEXTS} t ON b.doc_id = t.doc_id WHERE block <> '') WHERE rn <= 3 GROUP BY doc_id)"""


@query("K12_keyword_top", f"SELECT doc_id, small FROM {TOP_SQL}")
def k12(spark, d):
    return patterned(spark, d).select("doc_id", ops.keyword_top(F.col("markdown"), F.col("words")).alias("small"))


@query("K13_cosine_top_k", """WITH q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT query_id, block_id, floor(sim * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS similarity, rn FROM (SELECT query_id, vec_id AS block_id, list_cosine_similarity(embedding::DOUBLE[], v) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS rn
 FROM embeddings, q) WHERE rn <= 3""")
def k13(spark, d):
    """Queries are the mean vectors of the labels."""
    e = table(spark, d, "embeddings")
    items = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = items.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    out = cosine_top_k(e.select(F.col("vec_id").alias("block_id"), F.col("embedding").alias("vector")), queries)
    return out.withColumn("similarity", rounded(F.col("similarity"), 4))


METRICS = "concat('**Run**', chr(10), 'duration ', CAST(event_id AS VARCHAR(20)), chr(10), 'Executor count 4', chr(10), 'network idle', chr(10), 'rows read', chr(10), 'note: none', chr(10), 'plain')"
METRIC_CLS = "CASE event_id % 5 WHEN 0 THEN 'performance' WHEN 1 THEN 'resource' WHEN 2 THEN 'efficiency' WHEN 3 THEN 'security' ELSE 'general' END"


@query("K14_metric_lines", f"""SELECT statement_id, array_to_string(list_filter(string_split(m, chr(10)), lambda l: contains(l, '**') OR contains(l, ':') OR contains(lower(l), CASE event_id % 5 WHEN 0 THEN 'duration' WHEN 1 THEN 'executor' WHEN 2 THEN 'network' WHEN 3 THEN 'rows' ELSE '###' END)), chr(10)) AS kept
 FROM (SELECT statement_id, event_id, {METRICS} AS m FROM {H})""")
def k14(spark, d):
    return history(spark, d).select("statement_id", ops.metric_lines(F.expr(METRICS), F.expr(METRIC_CLS)).alias("kept"))


def compression(spark, d):
    g = patterned(spark, d)
    metrics = F.concat_ws("\n", F.lit("**Run**"), F.lit("duration 5"), F.lit("memory_util 3"), F.lit("plain"))
    return ops.compression_sizes(g.select("pattern", F.col("markdown").alias("context"), F.col("markdown").alias("guidelines"), metrics.alias("metrics")))


METRIC_TEXT = "concat_ws(chr(10), '**Run**', 'duration 5', 'memory_util 3', 'plain')"
COMPRESSED = f"""(SELECT sha256(concat_ws('|', {PATTERN}, markdown, markdown, {METRIC_TEXT})) AS cache_key, 2 * (length(markdown) // 4) + 9 AS original_tokens, any_value(length(c.small) // 4 + length(t.small) // 4 + length(CASE doc_id % 5 WHEN 0 THEN concat_ws(chr(10), '**Run**', 'duration 5') WHEN 1 THEN concat_ws(chr(10), '**Run**', 'memory_util 3') ELSE '**Run**' END) // 4) AS compressed_tokens
 FROM {GL} g JOIN {CONTEXT_SQL} c USING (doc_id) JOIN {TOP_SQL} t USING (doc_id) GROUP BY ALL)""".replace("2 * (length(markdown) // 4) + 9", f"2 * (length(markdown) // 4) + length({METRIC_TEXT}) // 4")


@query("K15_compression", f"SELECT cache_key, original_tokens, compressed_tokens, {rounded_sql('compressed_tokens / original_tokens::DOUBLE', 6)} AS ratio FROM {COMPRESSED}")
def k15(spark, d):
    return compression(spark, d).select("cache_key", "original_tokens", "compressed_tokens", rounded(F.col("ratio"), 6).alias("ratio"))


@query("A11_compression_stats", f"SELECT count(*) AS inputs, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens, {rounded_sql('sum(compressed_tokens) / sum(original_tokens)::DOUBLE', 6)} AS ratio FROM {COMPRESSED}")
def a11(spark, d):
    out = compression(spark, d).agg(F.count("*").alias("inputs"), F.sum("original_tokens").alias("original_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"))
    ratio = F.when(F.col("original_tokens") > 0, F.col("compressed_tokens") / F.col("original_tokens")).otherwise(1.0)
    return out.withColumn("ratio", rounded(ratio, 6))


# --- coverage -----------------------------------------------------------------------------------

RECS = view_sql("recommendations")
COVER_KEYS = ["SELECT_STAR", "CARTESIAN_JOIN", "NON_SARGABLE", "UNION_NO_ALL"]
ADDRESSED = f"(SELECT statement_id, rec_no, unnest(string_split(violations_csv, ',')) AS rule_key FROM {RECS} WHERE violations_csv <> '')"


@query("J8_uncovered_violations", f"SELECT v.statement_id, v.rule_key FROM ({expected_sql(COVER_KEYS)}) v WHERE NOT EXISTS (SELECT 1 FROM {ADDRESSED} a WHERE a.statement_id = v.statement_id AND a.rule_key = v.rule_key)")
def j8(spark, d):
    return ops.uncovered(violations(spark, d, COVER_KEYS), view(spark, d, "recommendations")).select("statement_id", "rule_key")


@query("J9_covered_by", f"""SELECT v.statement_id, v.rule_key, c.covered_by FROM ({expected_sql(COVER_KEYS)}) v JOIN (SELECT statement_id, rule_key, string_agg(DISTINCT '#' || rec_no, ', ' ORDER BY '#' || rec_no) AS covered_by FROM {ADDRESSED} GROUP BY 1, 2) c ON v.statement_id = c.statement_id AND v.rule_key = c.rule_key""")
def j9(spark, d):
    return ops.covered_by(violations(spark, d, COVER_KEYS), view(spark, d, "recommendations")).select("statement_id", "rule_key", "covered_by")


@query("K17_recommendation_check", f"""SELECT statement_id, rec_no, CASE WHEN rec_type IN ('code_fix', 'query_rewrite') AND violations_csv = '' AND NOT (contains(lower(description), 'no') AND (contains(lower(description), 'issue') OR contains(lower(description), 'optimized'))) THEN 'names no violation'
 WHEN length(description) < 20 THEN 'description too short' WHEN length(implementation) < 30 THEN 'implementation too short' WHEN expected_improvement = '' THEN 'no expected improvement'
 WHEN rec_type = 'cluster_config' AND NOT contains(description, 'i3.2xlarge') THEN 'unknown node type' END AS reason FROM {RECS}""")
def k17(spark, d):
    return ops.checked_recommendations(view(spark, d, "recommendations")).select("statement_id", "rec_no", "reason")
