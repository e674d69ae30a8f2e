"""Rules as code: failures stay their own, texts run once, blank texts reach no rule."""

from workloom.operators import detectors
from workloom.operators.code_rules import CodeRule, Found, detect_mixed, nesting, register_sql


def rules():
    """Local, so that the function itself and not its module's name goes to the workers."""
    def half(text):
        """Raises after a first finding, which goes too."""
        yield Found("low", "seen")
        if "boom" in text:
            raise KeyError("boom")

    return nesting(1), CodeRule("HALF", "T_002", half)


RULES = rules()
TEXTS = ["SELECT * FROM t", "SELECT ((a)) FROM t", "SELECT ((boom)) FROM t", "SELECT '((((' FROM t", None, "  ", "SELECT ((a)) FROM t -- again"]


def runs(spark):
    return spark.createDataFrame([(f"s{k}", "u", t) for k, t in enumerate(TEXTS)], "statement_id string, executed_by string, statement_text string")


def found(df):
    return sorted((r["statement_id"], r["rule_key"], r["ordinal"]) for r in df.collect())


EXPECTED = [("s0", "HALF", 2), ("s0", "SELECT_STAR", 1), ("s1", "DEEP_NESTING", 1), ("s1", "HALF", 2), ("s2", "DEEP_NESTING", 1),
            ("s3", "HALF", 1), ("s6", "DEEP_NESTING", 1), ("s6", "HALF", 2)]


def test_a_failing_rule_loses_its_own_findings(spark):
    assert found(detect_mixed(runs(spark), RULES, ["SELECT_STAR"])) == EXPECTED
    every = detect_mixed(runs(spark), RULES, ["SELECT_STAR"], failures=True)
    assert found(every) == sorted([*EXPECTED, ("s2", "HALF", 2)])
    failed = every.filter("severity = 'failed'").collect()
    assert [(r["statement_id"], r["message"]) for r in failed] == [("s2", "KeyError: 'boom'")]


def test_column_rules_keep_their_rows(spark):
    keys = ["SELECT_STAR", "CARTESIAN_JOIN"]
    assert found(detect_mixed(runs(spark), (), keys)) == found(detectors.detect_statements(runs(spark), keys))


def test_context_and_fix_arrive(spark):
    row = detect_mixed(runs(spark), RULES[:1], ["SELECT_STAR"]).filter("statement_id = 's1'").first()
    assert (row["context"], row["rule_id"], row["fix"]) == ({"depth": "2"}, "CODE_001", "Name the inner parts as CTEs")


def test_table_function_of_sql(spark):
    register_sql(spark, RULES, "t_findings")
    got = spark.sql("SELECT s.statement_id, f.rule_key, f.severity FROM {s} s, LATERAL t_findings(s.statement_text) f", s=runs(spark))
    assert sorted(map(tuple, got.filter("statement_id IN ('s1', 's2', 's4')").collect())) == [
        ("s1", "DEEP_NESTING", "medium"), ("s1", "HALF", "low"), ("s2", "DEEP_NESTING", "medium"), ("s2", "HALF", "failed")]
