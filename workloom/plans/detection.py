"""Anti-pattern detection over the whole history.

The comparison SQL states, per statement template, what a reader of the statement expects;
it shares no pattern with the detectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from workloom.functions.lexical import text_key
from workloom.functions.text import statement_hash
from workloom.operators import code_rules
from workloom.operators import detectors as det
from workloom.operators import findings_store, profile_store, rollups
from workloom.plans.history import H
from workloom.plans.registry import query
from workloom.session import shared_folder
from workloom.sources.tables import table
from workloom.sources.workload import view

# template, rule key, severity, detail that names the finding, numeric id
EXPECTED = (
    (0, "NON_SARGABLE", "high", "YEAR o_orderdate"),
    (23, "NON_SARGABLE", "high", "Mul o_totalprice"),
    (1, "SELECT_STAR", "high", "lineitem"),
    (2, "SELECT_STAR", "medium", "orders"),
    (1, "MISSING_PARTITION_FILTER", "critical", "l_shipdate"),
    (3, "CARTESIAN_JOIN", "critical", "cross_join"),
    (4, "CARTESIAN_JOIN", "critical", "implicit_comma"),
    (5, "CARTESIAN_JOIN", "critical", "join_without_on"),
    (6, "GROUP_BY_CARDINALITY", "high", "event_type, event_id"),
    (7, "DISTINCT_ON_UNIQUE", "medium", "user_id"),
    (8, "OR_TO_IN", "medium", "o_orderstatus: F, O, P"),
    (9, "LIKE_NO_WILDCARD", "low", "event_type: click"),
    (10, "CORRELATED_SUBQUERY", "high", "scalar_subquery_in_select: c.c_custkey"),
    (11, "IMPLICIT_CAST", "critical", "c_phone string numeric 5551234567"),
    (12, "MULTI_COUNT_DISTINCT", "high", "2: o_custkey, o_orderstatus"),
    (13, "NOT_IN_NULLS", "high", "subquery c_custkey"),
    (14, "NOT_IN_NULLS", "medium", "list s_nationkey"),
    (15, "WINDOW_NO_PARTITION", "high", "ROW_NUMBER"),
    (16, "UNION_NO_ALL", "medium", "2"),
    (17, "UNION_NO_ALL", "medium", "2"),
    (17, "UNION_NO_ALL", "medium", "3"),
    (17, "UNION_NO_ALL", "high", "4"),
    (18, "INEFFICIENT_MERGE", "high", "tgt no_condition"),
)
# How the detail is put together from a finding's context.
DETAIL = {
    "NON_SARGABLE": ("{function|operation} {column}"),
    "SELECT_STAR": "{table}",
    "MISSING_PARTITION_FILTER": "{missing_columns}",
    "CARTESIAN_JOIN": "{join_type}",
    "GROUP_BY_CARDINALITY": "{suggested_order}",
    "DISTINCT_ON_UNIQUE": "{unique_columns}",
    "OR_TO_IN": "{column}: {values}",
    "LIKE_NO_WILDCARD": "{column}: {pattern}",
    "CORRELATED_SUBQUERY": "{subquery_type}: {outer_columns}",
    "IMPLICIT_CAST": "{column} {column_class} {literal_class} {literal}",
    "MULTI_COUNT_DISTINCT": "{count}: {columns}",
    "NOT_IN_NULLS": "{kind} {column}",
    "WINDOW_NO_PARTITION": "{function}",
    "UNION_NO_ALL": "{branches}",
    "INEFFICIENT_MERGE": "{target} {reason}",
}


def detail(key: str):
    import re

    pieces = []
    for literal, names in re.findall(r"([^{]*)\{([^}]*)\}", DETAIL[key]):
        pieces += [F.lit(literal)] if literal else []
        pieces.append(F.coalesce(*[F.element_at("context", n) for n in names.split("|")]))
    return F.concat(*pieces)


def values_sql(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows) + ")"


def expected_sql(keys=None) -> str:
    rows = [r for r in EXPECTED if keys is None or r[1] in keys]
    return f"""SELECT h.statement_id, h.executed_by, h.statement_text, e.rule_key, e.severity, e.detail FROM {H} h
 JOIN {values_sql(rows)} e(template_id, rule_key, severity, detail) ON h.template_id = e.template_id"""


_STORES: dict[tuple[str, str], str] = {}


def profiled(spark, d):
    """The profiles of the sales tables, from a store that is written once per session and folder:
    the line items by ship month, orders and customers as a whole."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORES:
        path = f"{shared_folder(spark).rstrip('/')}/profiles-{uuid.uuid4().hex}"
        lines, orders, customers = (table(spark, d, t) for t in ("lineitem", "orders", "customer"))
        month = F.date_trunc("month", "l_shipdate")
        found = profile_store.states(lines, "main.sales.lineitem", ["l_shipdate", "l_quantity"], "l_shipdate", value=month)
        found = found.unionByName(profile_store.states(orders, "main.sales.orders", orders.columns, keys=("o_orderkey", "o_custkey")))
        found = found.unionByName(profile_store.states(customers, "main.sales.customer", customers.columns, keys=("c_custkey", "c_name")))
        profile_store.append(found, path, 1)
        _STORES[key] = path
    return profile_store.merged(profile_store.read(spark, _STORES[key], 1))


def partition_registry(spark, d):
    """(table_name, column_name): how tables are laid out, as the store knows it."""
    return profile_store.partition_columns(profiled(spark, d))


def history(spark, d):
    return view(spark, d, "history")


def violations(spark, d, keys=det.DEFAULT_RULES):
    return det.detect_statements(history(spark, d), keys)


def single(number: int, name: str, key: str):
    @query(f"D{number}_{name}", f"SELECT statement_id, severity, detail FROM ({expected_sql([key])})")
    def run(spark, d):
        context = {"partitions": partition_registry(spark, d)} if key == "MISSING_PARTITION_FILTER" else {}
        found = det.detect_statements(history(spark, d), [key], **context)
        return found.select("statement_id", "severity", detail(key).alias("detail"))


for _number, (_name, _key) in enumerate((
    ("non_sargable", "NON_SARGABLE"), ("select_star", "SELECT_STAR"),
    ("missing_partition_filter", "MISSING_PARTITION_FILTER"), ("cartesian_join", "CARTESIAN_JOIN"),
    ("group_by_cardinality", "GROUP_BY_CARDINALITY"), ("distinct_on_unique", "DISTINCT_ON_UNIQUE"),
    ("or_to_in", "OR_TO_IN"), ("like_no_wildcard", "LIKE_NO_WILDCARD"),
    ("correlated_subquery", "CORRELATED_SUBQUERY"), ("implicit_cast", "IMPLICIT_CAST"),
    ("multi_count_distinct", "MULTI_COUNT_DISTINCT"), ("not_in_nulls", "NOT_IN_NULLS"),
    ("window_no_partition", "WINDOW_NO_PARTITION"), ("union_no_all", "UNION_NO_ALL"),
    ("inefficient_merge", "INEFFICIENT_MERGE"),
), start=1):
    single(_number, _name, _key)


@query("D16_all_rules", f"""SELECT statement_id, rule_key, severity, row_number() OVER (PARTITION BY statement_id ORDER BY rule_order, detail) AS ordinal FROM (
 SELECT *, list_position({list(det.RULES)}, rule_key) AS rule_order FROM ({expected_sql()}))""")
def d16(spark, d):
    found = det.detect_statements(history(spark, d), None, partitions=partition_registry(spark, d))
    return found.select("statement_id", "rule_key", "severity", "ordinal")


@query("D17_default_rules", f"SELECT statement_id, rule_key, severity FROM ({expected_sql(det.DEFAULT_RULES)})")
def d17(spark, d):
    return violations(spark, d).select("statement_id", "rule_key", "severity")


@query("D18_blank_statements", f"""SELECT h.statement_id, CASE WHEN h.event_id % 10 = 0 THEN 0 ELSE count(e.rule_key) END AS violation_count
 FROM {H} h LEFT JOIN ({expected_sql(["SELECT_STAR", "UNION_NO_ALL"])}) e ON h.statement_id = e.statement_id GROUP BY h.statement_id, h.event_id""")
def d18(spark, d):
    h = history(spark, d).withColumn("statement_text", F.when(F.col("event_id") % 10 != 0, F.col("statement_text")).otherwise("  "))
    return det.with_statements(h, det.detect_statements(h, ["SELECT_STAR", "UNION_NO_ALL"])).select("statement_id", "violation_count")


FIXES = (
    (0, "Use a half-open range: o_orderdate >= start AND o_orderdate < end"),
    (23, "Leave o_totalprice alone and divide the literal instead"),
    (1, "Name the columns you need from lineitem"), (2, "Name the columns you need from orders"),
    (3, "Join on a key: JOIN customer ON orders.key = customer.key"),
    (4, "Write each table as a JOIN with its ON condition"),
    (5, "Join on a key: JOIN customer ON orders.key = customer.key"),
    (8, "Use o_orderstatus IN ('F', 'O', 'P')"),
    (11, "Quote the literal: c_phone = '5551234567'"),
    (12, "If 2% error is fine use approx_count_distinct(o_custkey), approx_count_distinct(o_orderstatus), or split the counts and join them"),
)


@query("D19_fix_texts", f"SELECT h.statement_id, e.fix FROM {H} h JOIN {values_sql(FIXES)} e(template_id, fix) ON h.template_id = e.template_id")
def d19(spark, d):
    keys = [*det.DEFAULT_RULES, "OR_TO_IN", "IMPLICIT_CAST", "MULTI_COUNT_DISTINCT"]
    return violations(spark, d, keys).select("statement_id", "fix")


@query("D20_distinct_texts", f"""SELECT substr(sha256(statement_text), 1, 12) AS query_hash, count(DISTINCT statement_id) AS executions, count(DISTINCT detail) AS findings
 FROM (SELECT h.statement_id, h.statement_text, e.detail FROM {H} h LEFT JOIN ({expected_sql(["UNION_NO_ALL", "CARTESIAN_JOIN"])}) e ON h.statement_id = e.statement_id) GROUP BY 1""")
def d20(spark, d):
    """Findings are counted on the distinct texts, executions on the history."""
    h = history(spark, d)
    found = det.detect(det.with_context(det.distinct_texts(h)), ["UNION_NO_ALL", "CARTESIAN_JOIN"])
    per_text = found.groupBy(F.sha2("statement_text", 256).alias("digest")).agg(F.count("*").alias("findings"))
    runs = h.groupBy(
        statement_hash(F.col("statement_text")).alias("query_hash"), text_key(F.col("statement_text")).alias("digest"),
    ).agg(F.count("*").alias("executions"))
    return runs.join(per_text, "digest", "left").select("query_hash", "executions", F.coalesce("findings", F.lit(0)).alias("findings"))


@query("D20_stored_findings", f"""SELECT h.statement_id, e.rule_key, e.severity, CASE WHEN h.template_id < 12 THEN 1 ELSE 2 END AS batch
 FROM {H} h JOIN {values_sql(EXPECTED)} e(template_id, rule_key, severity, detail) ON h.template_id = e.template_id""")
def d20_stored(spark, d):
    """Two runs against one store: the second one meets the texts of the first and analyses only the others."""
    path = f"{shared_folder(spark).rstrip('/')}/findings-{uuid.uuid4().hex}"
    h, facts = history(spark, d), partition_registry(spark, d)
    findings_store.analyse(h.filter("template_id < 12"), path, "1", partitions=facts)
    found = findings_store.detect_stored(h, path, "1", partitions=facts)
    return found.select("statement_id", "rule_key", "severity", "batch")


@query("P10_severity_filter", f"SELECT statement_id, rule_key, severity FROM ({expected_sql(['SELECT_STAR', 'CARTESIAN_JOIN', 'NON_SARGABLE'])}) WHERE severity IN ('critical', 'high')")
def p10(spark, d):
    return violations(spark, d).filter(F.col("severity").isin("critical", "high")).select("statement_id", "rule_key", "severity")


@query("P11_gate", f"""SELECT h.statement_id, count(e.rule_key) AS critical_count, CASE WHEN count(e.rule_key) > 0 THEN 'reject' ELSE 'pass' END AS gate
 FROM {H} h LEFT JOIN ({expected_sql(det.DEFAULT_RULES)}) e ON h.statement_id = e.statement_id AND e.severity = 'critical' GROUP BY 1""")
def p11(spark, d):
    return rollups.gate(history(spark, d), violations(spark, d))


# Rule configuration measured from the customer table: the latest row per rule key wins.
CONFIG = """SELECT CASE c_custkey % 3 WHEN 0 THEN 'SELECT_STAR' WHEN 1 THEN 'CARTESIAN_JOIN' ELSE 'NON_SARGABLE' END AS rule_key,
 CASE WHEN c_custkey % 2 = 0 THEN 'low' ELSE NULL END AS severity, c_custkey % 5 <> 4 AS enabled,
 CASE WHEN c_custkey % 4 = 0 THEN concat('see ', c_name) ELSE NULL END AS custom_message, CASE WHEN c_custkey % 7 < 3 THEN 0.9 ELSE NULL END AS confidence, c_custkey
FROM {customer}"""


@query("J7_rule_config", f"""SELECT v.statement_id, v.rule_key, coalesce(c.severity, v.severity) AS severity, c.custom_message IS NOT NULL AS overridden, CAST(coalesce(c.confidence, 0.8) AS DOUBLE) AS confidence
 FROM ({expected_sql(det.DEFAULT_RULES)}) v LEFT JOIN (SELECT * FROM ({CONFIG.format(customer='customer')}) QUALIFY row_number() OVER (PARTITION BY rule_key ORDER BY c_custkey DESC) = 1) c
 ON v.rule_key = c.rule_key WHERE coalesce(c.enabled, TRUE)""")
def j7(spark, d):
    from workloom.operators.ranking import latest_per_key

    config = latest_per_key(spark.sql(CONFIG, customer=table(spark, d, "customer")), ["rule_key"], F.col("c_custkey"))
    config = config.withColumn("confidence", F.col("confidence").cast("double"))
    out = det.with_rule_config(violations(spark, d), config)
    return out.select("statement_id", "rule_key", "severity", F.col("message").startswith("see ").alias("overridden"), "confidence")

# --- facts that decide: statements whose names say nothing, one per order --------------------------

FACT_TEXTS = """CASE o_orderkey % 4 WHEN 0 THEN concat('SELECT DISTINCT c_name FROM main.sales.customer WHERE c_acctbal > ', CAST(o_custkey AS VARCHAR(20)))
 WHEN 1 THEN concat('SELECT DISTINCT c_mktsegment FROM main.sales.customer WHERE c_acctbal > ', CAST(o_custkey AS VARCHAR(20)))
 WHEN 2 THEN concat('SELECT o_totalprice FROM main.sales.orders WHERE o_orderpriority = ', CAST(o_custkey AS VARCHAR(20)))
 ELSE concat('SELECT o_totalprice FROM main.sales.orders WHERE o_orderstatus = "', o_orderstatus, '"') END"""


def fact_statements(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("statement_id"), F.col("o_custkey").cast("string").alias("executed_by"),
        F.expr(FACT_TEXTS).alias("statement_text"))


@query("D6_measured_unique", """SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, 'c_name' AS detail FROM orders
 WHERE o_orderkey % 4 = 0 AND (SELECT count(DISTINCT c_name) = count(*) FROM customer)""")
def d6_measured(spark, d):
    """DISTINCT over a column that the profile store has proven unique, though its name does not say so."""
    uniques = profile_store.unique_columns(profiled(spark, d))
    found = det.detect_statements(fact_statements(spark, d), ["DISTINCT_ON_UNIQUE"], uniques=uniques)
    return found.select("statement_id", detail("DISTINCT_ON_UNIQUE").alias("detail"))


@query("D10_declared_types", """SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, 'o_orderpriority string numeric ' || o_custkey AS detail FROM orders
 WHERE o_orderkey % 4 = 2""")
def d10_declared(spark, d):
    """A number compared with a column whose type only the profile store knows to be text."""
    columns = profile_store.column_types(profiled(spark, d))
    found = det.detect_statements(fact_statements(spark, d), ["IMPLICIT_CAST"], columns=columns)
    return found.select("statement_id", detail("IMPLICIT_CAST").alias("detail"))


# --- rules as code: statements whose parentheses are as deep as their order's key says ---------------

NESTED_TEXTS = """CASE WHEN o_orderkey % 7 = 0 THEN concat('SELECT * FROM main.sales.orders WHERE o_custkey = ', CAST(o_custkey AS STRING))
 ELSE concat('SELECT ', repeat('(', int(o_orderkey % 6)), 'o_totalprice', repeat(')', int(o_orderkey % 6)), ' FROM main.sales.orders WHERE o_comment <> "((((((" AND o_custkey = ', CAST(o_custkey AS STRING)) END"""


def nested_statements(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("statement_id"), F.col("o_custkey").cast("string").alias("executed_by"),
        F.expr(NESTED_TEXTS).alias("statement_text"))


def _odd_customers(text):
    """A rule that raises on every text of a customer whose key ends in 3."""
    if text.endswith("3"):
        raise ValueError("no such customer")
    return [code_rules.Found("low", "customer ends in 4")] if text.endswith("4") else []


CODE_RULES = (code_rules.nesting(3), code_rules.CodeRule("CUSTOMER_DIGIT", "CODE_002", _odd_customers))
BY_CODE = """SELECT CAST(o_orderkey AS VARCHAR) AS statement_id, 'DEEP_NESTING' AS rule_key, 'medium' AS severity, 1 AS place FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 6 > 3
 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'CUSTOMER_DIGIT', CASE WHEN o_custkey % 10 = 3 THEN 'failed' ELSE 'low' END, 2 FROM orders WHERE o_custkey % 10 IN (3, 4)"""


@query("F1_code_rules", f"""SELECT statement_id, rule_key, severity, row_number() OVER (PARTITION BY statement_id ORDER BY place) AS ordinal FROM ({BY_CODE}
 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'SELECT_STAR', 'high', 0 FROM orders WHERE o_orderkey % 7 = 0)""")
def f1_code(spark, d):
    """A Column rule and two rules as code in one pass; the one that raises loses its own findings only."""
    found = code_rules.detect_mixed(nested_statements(spark, d), CODE_RULES, ["SELECT_STAR"], failures=True)
    return found.select("statement_id", "rule_key", "severity", "ordinal")


@query("F1_sql_rules", f"SELECT statement_id, rule_key, severity FROM ({BY_CODE})")
def f1_sql(spark, d):
    """The same code rules as a table function of SQL."""
    code_rules.register_sql(spark, CODE_RULES, "code_findings")
    return spark.sql("SELECT s.statement_id, f.rule_key, f.severity FROM {s} s, LATERAL code_findings(s.statement_text) f",
                     s=nested_statements(spark, d))
