"""Findings between runs: only new texts are analysed, and the rows stay those of a plain run."""

from workloom.operators import detectors, findings_store

TEXTS = ["SELECT * FROM a.b.t", "SELECT x FROM t WHERE YEAR(d) = 2024", "SELECT x FROM t", "SELECT a FROM t UNION SELECT a FROM u"]


def runs(spark, texts):
    return spark.createDataFrame([(f"s{k}", "u", t) for k, t in enumerate(texts)], "statement_id string, executed_by string, statement_text string")


def rows(df):
    return sorted((r["statement_id"], r["rule_key"], r["ordinal"], r["message"], r["fix"], sorted(r["context"].items())) for r in df.collect())


def test_only_new_texts_are_analysed(spark, tmp_path):
    path, later = str(tmp_path), [*TEXTS, TEXTS[0] + " -- again", TEXTS[2], "SELECT * FROM a.b.u", None, "  "]
    assert findings_store.analyse(runs(spark, TEXTS[:3]), path, "1") == 3
    assert findings_store.analyse(runs(spark, TEXTS[:3]), path, "1") == 0
    assert findings_store.analyse(runs(spark, later), path, "1") == 2
    got = findings_store.findings(runs(spark, later), path, "1")
    assert rows(got) == rows(detectors.detect_statements(runs(spark, later)))
    assert {(r["statement_id"], r["batch"]) for r in got.collect()} >= {("s0", 1), ("s3", 2), ("s4", 1), ("s6", 2)}


def test_another_rule_version_starts_anew(spark, tmp_path):
    path = str(tmp_path)
    assert findings_store.analyse(runs(spark, TEXTS), path, "1", ["SELECT_STAR"]) == 4
    assert findings_store.analyse(runs(spark, TEXTS), path, "2", ["UNION_NO_ALL"]) == 4
    assert [r["rule_key"] for r in findings_store.findings(runs(spark, TEXTS), path, "2").collect()] == ["UNION_NO_ALL"]


def test_compaction_keeps_the_findings(spark, tmp_path):
    path = str(tmp_path)
    findings_store.compact(spark, path, "1")
    for n in (1, 3, 4):
        findings_store.analyse(runs(spark, TEXTS[:n]), path, "1")
    before = rows(findings_store.findings(runs(spark, TEXTS), path, "1"))
    findings_store.compact(spark, path, "1")
    known = findings_store.stored(spark, path, "1")
    assert known.count() == 4 and known.select("generation", "batch").distinct().count() == 1
    assert rows(findings_store.findings(runs(spark, TEXTS), path, "1")) == before
    assert findings_store.analyse(runs(spark, [*TEXTS, "SELECT 1"]), path, "1") == 1
    assert findings_store.stored(spark, path, "1").count() == 5
