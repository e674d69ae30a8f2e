"""Golden statements: which rules fire, with the context that matters."""

import pytest
from pyspark.sql import functions as F

from workloom.functions.text import statement_hash
from workloom.operators import detectors as d
from workloom.sources.workload import TEMPLATES

GOLDEN = {
    0: [("NON_SARGABLE", "high")], 1: [("SELECT_STAR", "high"), ("MISSING_PARTITION_FILTER", "critical")],
    2: [("SELECT_STAR", "medium")], 3: [("CARTESIAN_JOIN", "critical")], 4: [("CARTESIAN_JOIN", "critical")],
    5: [("CARTESIAN_JOIN", "critical")], 6: [("GROUP_BY_CARDINALITY", "high")], 7: [("DISTINCT_ON_UNIQUE", "medium")],
    8: [("OR_TO_IN", "medium")], 9: [("LIKE_NO_WILDCARD", "low")], 10: [("CORRELATED_SUBQUERY", "high")],
    11: [("IMPLICIT_CAST", "critical")], 12: [("MULTI_COUNT_DISTINCT", "high")], 13: [("NOT_IN_NULLS", "high")],
    14: [("NOT_IN_NULLS", "medium")], 15: [("WINDOW_NO_PARTITION", "high")], 16: [("UNION_NO_ALL", "medium")],
    17: [("UNION_NO_ALL", "medium"), ("UNION_NO_ALL", "medium"), ("UNION_NO_ALL", "high")],
    18: [("INEFFICIENT_MERGE", "high")], 23: [("NON_SARGABLE", "high")],
}

# (statement, rule, expected number of findings, context entries of the first one)
CASES = [
    ("SELECT a FROM t WHERE a = 1 AND UPPER(TRIM(name)) = 'X' OR CAST(price AS INT) = 5", "NON_SARGABLE", 2, {"function": "UPPER", "column": "name"}),
    ("SELECT a FROM t WHERE d >= date_trunc('month', now())", "NON_SARGABLE", 0, {}),
    ("SELECT a FROM t WHERE date_trunc('month', t.d) = '2024-01-01'", "NON_SARGABLE", 1, {"function": "DATE_TRUNC", "column": "d"}),
    ("SELECT a FROM t WHERE (a + b) * 2 > 5 AND note = 'x * y > 3'", "NON_SARGABLE", 1, {"operation": "Mul"}),
    ("SELECT a FROM t WHERE id IN (SELECT id FROM s WHERE YEAR(d) = 2024 GROUP BY id) AND MONTH(e) = 3", "NON_SARGABLE", 2, {}),
    ("SELECT a FROM t WHERE note = 'AND year(x) = 1'", "NON_SARGABLE", 0, {}),
    ("SELECT COUNT(*) FROM t", "SELECT_STAR", 0, {}),
    ("SELECT t.*, a FROM t", "SELECT_STAR", 0, {}),
    ("SELECT f(x, y), * FROM a.b.t", "SELECT_STAR", 1, {"table": "t"}),
    ("SELECT a FROM (SELECT * FROM t) x UNION ALL SELECT * FROM u", "SELECT_STAR", 2, {}),
    ("SELECT a * b FROM t", "SELECT_STAR", 0, {}),
    ("SELECT a FROM t CROSS JOIN u", "CARTESIAN_JOIN", 1, {"join_type": "cross_join"}),
    ("SELECT a FROM t JOIN u JOIN v ON v.k = t.k", "CARTESIAN_JOIN", 1, {"join_type": "join_without_on"}),
    ("SELECT a FROM t JOIN u ON f(t.a, 1) = u.a", "CARTESIAN_JOIN", 0, {}),
    ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u, v)", "CARTESIAN_JOIN", 1, {"join_type": "cross_join"}),
    ("SELECT a, b FROM t GROUP BY status, user_id", "GROUP_BY_CARDINALITY", 0, {}),
    ("SELECT 1 FROM t GROUP BY 1, session_id, amount, date_trunc('day', ts), country", "GROUP_BY_CARDINALITY", 1, {"suggested_order": "country, amount, ts, session_id"}),
    ("SELECT DISTINCT name AS n, country FROM t", "DISTINCT_ON_UNIQUE", 0, {}),
    ("SELECT DISTINCT t.order_id AS k, c FROM t", "DISTINCT_ON_UNIQUE", 1, {"unique_columns": "order_id"}),
    ("SELECT a FROM t WHERE b = 1 AND (c = 1 OR c = 2 OR 3 = c OR d = 'z')", "OR_TO_IN", 1, {"column": "c", "values": "1, 2, 3"}),
    ("SELECT a FROM t WHERE c = 1 OR c = 2 OR c = 3 AND d = 4", "OR_TO_IN", 0, {}),
    ("SELECT a FROM t WHERE c LIKE 'a%' AND d LIKE 'b_' AND e NOT LIKE 'plain'", "LIKE_NO_WILDCARD", 1, {"pattern": "plain", "column": "e"}),
    ("SELECT a FROM t WHERE p > (SELECT AVG(p) FROM u WHERE u.k = t.k)", "CORRELATED_SUBQUERY", 1, {"subquery_type": "aggregate_subquery_in_where", "outer_columns": "t.k"}),
    ("SELECT a FROM t WHERE p IN (SELECT u.p FROM main.x.u AS u JOIN w ON w.k = u.k WHERE u.z = t.z)", "CORRELATED_SUBQUERY", 1, {"subquery_type": "subquery_in_where"}),
    ("SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.k = t.k)", "CORRELATED_SUBQUERY", 0, {}),
    ("SELECT a FROM t WHERE order_total = '12' AND ship_date = '2024-01-05' AND zip = 123", "IMPLICIT_CAST", 2, {"column": "order_total", "literal_class": "string"}),
    ("SELECT a FROM t WHERE '2024-01-05' <= t.created_time AND note = 'x = 1'", "IMPLICIT_CAST", 0, {}),
    ("SELECT COUNT(DISTINCT a), SUM(b), COUNT(DISTINCT lower(c)) FROM t", "MULTI_COUNT_DISTINCT", 1, {"count": "2", "columns": "a, lower(c)"}),
    ("SELECT COUNT(DISTINCT a) FROM t UNION ALL SELECT COUNT(DISTINCT b) FROM u", "MULTI_COUNT_DISTINCT", 0, {}),
    ("SELECT a FROM t WHERE k NOT IN (SELECT k FROM u WHERE k IS NOT NULL)", "NOT_IN_NULLS", 0, {}),
    ("SELECT a FROM t WHERE NOT k IN ('a', 'b')", "NOT_IN_NULLS", 1, {"kind": "list"}),
    ("SELECT SUM(x) OVER (PARTITION BY a ORDER BY b), LAG(y, 1) OVER (ORDER BY abs(b)) FROM t", "WINDOW_NO_PARTITION", 1, {"function": "LAG"}),
    ("SELECT a FROM (SELECT 1 AS a UNION SELECT 2) x UNION ALL SELECT 3", "UNION_NO_ALL", 1, {"branches": "2"}),
    ("MERGE INTO a.b.tgt t USING s ON t.k = s.k WHEN MATCHED AND s.live = 1 THEN UPDATE SET t.v = s.v", "INEFFICIENT_MERGE", 1, {"reason": "no_change_check", "target": "tgt"}),
    ("MERGE INTO tgt t USING s ON t.k = s.k WHEN MATCHED AND md5(t.v) <> md5(s.v) THEN UPDATE SET t.v = s.v", "INEFFICIENT_MERGE", 0, {}),
    ("MERGE INTO tgt t USING s ON t.k = s.k WHEN MATCHED THEN DELETE", "INEFFICIENT_MERGE", 0, {}),
    # literals, comments and identifiers
    ("SELECT a FROM t WHERE note = 'x--y' AND YEAR(d) = 2024", "NON_SARGABLE", 1, {"function": "YEAR", "column": "d"}),
    ("SELECT a FROM t WHERE note = 'it\\'s' AND YEAR(d) = 2024 AND b = 'z'", "NON_SARGABLE", 1, {"function": "YEAR"}),
    ("SELECT a FROM t WHERE note = 'it''s' AND YEAR(d) = 2024 AND b = 'z'", "NON_SARGABLE", 1, {"function": "YEAR"}),
    ("SELECT a FROM t WHERE note = '/* x' AND YEAR(d) = 2024 AND b = '*/'", "NON_SARGABLE", 1, {"function": "YEAR"}),
    ('SELECT a FROM t WHERE note = "x UNION y"', "UNION_NO_ALL", 0, {}),
    ('SELECT a FROM t WHERE note = "it\'s" UNION SELECT b FROM u', "UNION_NO_ALL", 1, {}),
    ("SELECT a FROM t -- it's UNION\n UNION SELECT b FROM u", "UNION_NO_ALL", 1, {}),
    ("SELECT * FROM `main`.`s`.`t`", "SELECT_STAR", 1, {"table": "t"}),
    ("SELECT * FROM main.s.`my t`", "SELECT_STAR", 1, {"table": "my_t"}),
    ("SELECT a FROM t WHERE note = 'open AND YEAR(d) = 2024", "NON_SARGABLE", 0, {}),
    # any depth
    ("SELECT a FROM t WHERE p > (SELECT MAX(COALESCE(ABS(u.p), 0)) FROM u WHERE u.k = t.k)", "CORRELATED_SUBQUERY", 1,
     {"outer_columns": "t.k", "subquery_type": "aggregate_subquery_in_where"}),
    ("SELECT a FROM t WHERE UPPER(f(g(h(i(j(name)))))) = 'X'", "NON_SARGABLE", 1, {"function": "UPPER", "column": "name"}),
    ("SELECT SUM(COALESCE(ROUND(ABS(x)), 0)) OVER (ORDER BY b) FROM t", "WINDOW_NO_PARTITION", 1, {"function": "SUM"}),
    ("SELECT COUNT(DISTINCT x) OVER (ORDER BY f(g(h(b)))), MAX(y) OVER (PARTITION BY f(g(h(b)))) FROM t", "WINDOW_NO_PARTITION", 1, {"function": "COUNT"}),
    ("SELECT a FROM t WHERE ((((((((((YEAR(d) = 2024))))))))))", "NON_SARGABLE", 1, {"function": "YEAR", "column": "d"}),
    # conditions anywhere inside WHERE
    ("SELECT a FROM t WHERE CASE WHEN YEAR(d) = 2024 THEN 1 ELSE 0 END = 1", "NON_SARGABLE", 1, {"function": "YEAR", "column": "d", "predicate": "YEAR(d) = 2024"}),
    ("SELECT CASE WHEN YEAR(d) = 2024 THEN 1 END FROM t WHERE a = 1", "NON_SARGABLE", 0, {}),
    ("SELECT a FROM t WHERE b = 1 AND (YEAR(d) = 2024 OR c = 2)", "NON_SARGABLE", 1, {"function": "YEAR"}),
    ("SELECT a FROM t WHERE ((b = 1 OR UPPER(n) = 'X') AND (c = 2 OR NOT (e = 1 AND MONTH(d) = 3)))", "NON_SARGABLE", 2, {"function": "UPPER"}),
    ("SELECT a FROM t JOIN u ON (t.k = u.k AND YEAR(t.d) = 2024) WHERE t.a = 1", "NON_SARGABLE", 0, {}),
    ("SELECT a FROM t WHERE (b = 1 OR k IN (SELECT k FROM u WHERE (YEAR(d) = 2024 OR z = 1)))", "NON_SARGABLE", 1, {"function": "YEAR"}),
    ("SELECT a FROM t GROUP BY a HAVING (YEAR(MAX(d)) = 2024 OR COUNT(*) > 1)", "NON_SARGABLE", 0, {}),
    ("SELECT a FROM t WHERE b = CASE c WHEN 'x' THEN CASE WHEN UPPER(n) = 'Y' THEN 1 END ELSE 2 END", "NON_SARGABLE", 1, {"column": "n"}),
    ("SELECT a FROM t WHERE (c = 1 OR c = 2 OR c = 3) AND (d = 1 OR d = 2)", "OR_TO_IN", 1, {"column": "c"}),
    ("SELECT a FROM t WHERE x = 1 OR (y = 2 AND z = 3) OR x = 2 OR x = 3", "OR_TO_IN", 1, {"column": "x"}),
    ("SELECT a FROM t WHERE b = 1 AND (order_total = '12' OR note = 'z')", "IMPLICIT_CAST", 1, {"column": "order_total"}),
    ("SELECT a FROM t WHERE (l_id = 1 OR CASE WHEN alive THEN flag ELSE 'n' END = 'y')", "NON_SARGABLE", 0, {}),
    ("MERGE INTO tgt t USING s ON t.k = s.k WHEN MATCHED AND (t.v <> s.v OR t.w <> s.w) THEN UPDATE SET t.v = s.v", "NON_SARGABLE", 0, {}),
    # named windows
    ("SELECT SUM(x) OVER w FROM t WINDOW w AS (ORDER BY b)", "WINDOW_NO_PARTITION", 1, {"function": "SUM"}),
    ("SELECT SUM(x) OVER w FROM t WINDOW w AS (PARTITION BY a ORDER BY b)", "WINDOW_NO_PARTITION", 0, {}),
    ("SELECT SUM(x) OVER w, RANK() OVER v FROM t WINDOW w AS (PARTITION BY a), v AS (ORDER BY abs(b) DESC)", "WINDOW_NO_PARTITION", 1, {"function": "RANK"}),
    ("SELECT SUM(x) OVER (w), MAX(f(y)) OVER (v ORDER BY c) FROM t WINDOW w AS (PARTITION BY a), v AS (w)", "WINDOW_NO_PARTITION", 0, {}),
    ("SELECT SUM(x) OVER (w) FROM t WINDOW v AS (ORDER BY b), w AS v", "WINDOW_NO_PARTITION", 1, {"function": "SUM"}),
    ("SELECT SUM(x) OVER w FROM t WINDOW w AS (ORDER BY b) UNION ALL SELECT SUM(x) OVER w FROM u WINDOW w AS (PARTITION BY a)", "WINDOW_NO_PARTITION", 1, {}),
    ("SELECT a FROM (SELECT a, COUNT(DISTINCT z) OVER w FROM t WHERE (a = 1 OR b = 2) WINDOW w AS (ORDER BY b)) q", "WINDOW_NO_PARTITION", 1, {"function": "COUNT"}),
    ("SELECT LAG(x, 1) OVER W FROM t WINDOW w AS ()", "WINDOW_NO_PARTITION", 1, {"function": "LAG"}),
    ("SELECT SUM(x) OVER (), SUM(y) OVER (ROWS UNBOUNDED PRECEDING) FROM t", "WINDOW_NO_PARTITION", 2, {"function": "SUM"}),
    ("SELECT a AS window FROM t WHERE note = 'OVER w WINDOW w AS (ORDER BY b)'", "WINDOW_NO_PARTITION", 0, {}),
    ("SELECT a FROM t WHERE k NOT IN (SELECT k FROM (SELECT k FROM (SELECT k FROM (SELECT k FROM u) v) w) x)", "NOT_IN_NULLS", 1, {"column": "k", "kind": "subquery"}),
    ("SELECT a FROM t WHERE x IN (SELECT k FROM u) AND y NOT IN (SELECT k FROM u)", "NOT_IN_NULLS", 1, {"column": "y"}),
    ("SELECT a FROM t WHERE c = 1 OR c = 2 OR c = 3 OR c = 4 OR c = 5 OR c = 6 OR c = 7 OR c = 8 OR c = 9 OR c = 10 OR c = 11", "OR_TO_IN", 1,
     {"values": "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11"}),
]


@pytest.fixture(scope="module")
def findings(spark):
    texts = list(TEMPLATES) + [c[0] for c in CASES]
    df = spark.createDataFrame([(t,) for t in texts], "statement_text string").withColumn(
        "query_hash", statement_hash(F.col("statement_text")))
    parts = spark.createDataFrame([("main.sales.lineitem", "l_shipdate")], "table_name string, column_name string")
    out = {}
    for r in d.detect(d.with_context(df, partitions=parts)).orderBy("ordinal").collect():
        out.setdefault(r.statement_text, []).append(r)
    return out


@pytest.mark.parametrize("number", range(24))
def test_templates(findings, number):
    got = [(r.rule_key, r.severity) for r in findings.get(TEMPLATES[number], [])]
    assert got == GOLDEN.get(number, [])


@pytest.mark.parametrize("text,rule,count,context", CASES)
def test_cases(findings, text, rule, count, context):
    got = [r for r in findings.get(text, []) if r.rule_key == rule]
    assert len(got) == count, got
    if got:
        assert context.items() <= got[0].context.items()


def test_context_tables(spark):
    """Registered unique columns and declared types decide before the name guesses."""
    df = spark.createDataFrame(
        [("SELECT DISTINCT batch_no FROM main.x.t WHERE alpha = 'q' AND order_total = 'q'",)], "statement_text string"
    ).withColumn("query_hash", statement_hash(F.col("statement_text")))
    uniq = spark.createDataFrame([("main.x.t", "batch_no")], "table_name string, column_name string")
    cols = spark.createDataFrame(
        [("main.x.t", "alpha", "bigint"), ("main.x.t", "order_total", "string")], "table_name string, column_name string, data_type string")
    rows = d.detect(d.with_context(df, uniques=uniq, columns=cols)).collect()
    assert [(r.rule_key, r.context.get("column")) for r in rows] == [("DISTINCT_ON_UNIQUE", None), ("IMPLICIT_CAST", "alpha")]


def test_custom_rule(spark):
    d.register_rule("LIMIT_MISSING", "TEAM_001", "low", lambda: F.when(
        ~d.S.code.rlike(r"(?i)\bLIMIT\b"), F.array(d.finding("low", F.lit("no limit"), F.lit("add LIMIT")))))
    try:
        df = spark.createDataFrame([("SELECT a FROM t",), ("SELECT a FROM t LIMIT 1",)], "statement_text string")
        rows = d.detect(d.with_context(df), ["LIMIT_MISSING"]).collect()
        assert [r.statement_text for r in rows] == ["SELECT a FROM t"]
    finally:
        d.unregister_rule("LIMIT_MISSING")
