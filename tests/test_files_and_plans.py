"""File sources, sinks, the rules table, and the plans that the rewrites promise."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from workloom.functions import metrics, names, text
from workloom.operators import retrieval, statement_sections
from workloom.operators import rewrites as r
from workloom.plans import load_all
from workloom.plans.registry import QUERIES
from workloom.sources import sinks, workspace
from workloom.sources.tables import table

load_all()
FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sql_and_guideline_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.sql").write_text("SELECT 1\nFROM t\n")
    (tmp_path / "sub" / "b.sql").write_text("SELECT 2")
    (tmp_path / "c.txt").write_text("no")
    got = {row.path.rsplit("/", 1)[1]: row.statement_text for row in workspace.sql_files(spark, str(tmp_path)).collect()}
    assert got == {"a.sql": "SELECT 1\nFROM t\n", "b.sql": "SELECT 2"}
    (tmp_path / "g.md").write_text("## A\ntext ü")
    (tmp_path / "sub" / "big.md").write_text("x" * 2000)
    docs = workspace.guideline_files(spark, str(tmp_path), max_bytes=1000).collect()
    assert [d.markdown for d in docs] == ["## A\ntext ü"]
    assert workspace.guideline_files(spark, str(tmp_path)).count() == 2
    left_out, = workspace.skipped_files(spark, str(tmp_path), max_bytes=1000).collect()
    assert left_out.path.endswith("big.md") and (left_out.bytes, left_out.reason) == (2000, "larger than 1000 bytes")
    assert workspace.skipped_files(spark, str(tmp_path)).count() == 0


def test_files_are_written_and_listed_by_many_tasks(spark, tmp_path):
    """Few bytes, many files: neither side may be packed into one task, nor go through the driver."""
    rows = [(i % 400, f"text {i % 400}\nü") for i in range(500)] + [(1000, None), (1001, "")]
    path = f"{tmp_path}/texts"
    df = spark.createDataFrame(rows, "k bigint, t string")
    sinks.write_files(df.limit(3), path, "k", "t")
    sinks.write_files(df, path, "k", "t")
    assert len(list((tmp_path / "texts").iterdir())) > 1
    (tmp_path / "texts" / "_hidden.txt").write_text("x")
    (tmp_path / "texts" / "empty.txt").write_text("")
    got = workspace.guideline_files(spark, path, "*.txt")
    assert got.rdd.getNumPartitions() > 1
    want = {k: f"text {k}\nü\n" * (2 if k < 100 else 1) for k in range(400)} | {1001: "\n"}
    assert {int(r.path.split("k=")[1].split("/")[0]): r.markdown for r in got.collect()} == want
    texts = workspace.sql_files(spark, path, "*.txt")
    assert "FileScan" not in plan(texts) and texts.rdd.getNumPartitions() > 1
    assert {int(r.path.split("k=")[1].split("/")[0]): r.statement_text for r in texts.collect()} == want
    left_out = workspace.skipped_files(spark, path, "*.txt", max_bytes=12).collect()
    assert {r.bytes for r in left_out} == {len(t.encode()) for t in want.values() if len(t.encode()) > 12}
    assert workspace.guideline_files(spark, path, "*.txt", recursive=False).count() == 0


def test_budget_reads_the_sections_once(spark):
    assert "documents.parquet" not in plan(QUERIES["W7_budget_skip"](spark, FOLDER))


def test_overlaps_derive_no_filter_on_the_tables(spark):
    """Such a filter runs the analysis that finds the tables on every row below the grouping."""
    sets = spark.range(9).select(F.split(F.concat(F.lit("a,b"), F.col("id") % 3), ",").alias("tables")).distinct()
    scored = spark.createDataFrame([(1, 10, 5, ["a"], 10), (2, 10, 5, [], 10), (3, 10, 5, None, 10)],
                                   "doc_id bigint, priority int, tokens bigint, affected_tables array<string>, score int")
    found = statement_sections.overlaps(sets, scored, ["doc_id"])
    assert "size(" not in plan(found) and {(r.doc_id, r.score) for r in found.collect()} == {(1, -5)} and found.count() == 3


def test_texts_are_lowered_once_per_paragraph(spark):
    row = spark.createDataFrame([("Slow SLOW scan", ["scan", "slow"], "slow"), (None, ["scan"], "slow")], "t string, words array<string>, cls string")
    out = row.select(retrieval.section_score(F.col("t"), F.col("words"), F.col("cls")).alias("score"))
    assert plan(out).count("lower(") == 1 and [r.score for r in out.collect()] == [6, None]
    words = row.select(retrieval.priority_words(F.col("t"), F.col("t")).alias("w"))
    assert plan(words).count("upper(") == 2


def test_rules_table(spark):
    spark.sql("DROP TABLE IF EXISTS wl_rules")
    sinks.ensure_rules_table(spark, "wl_rules")
    sinks.ensure_rules_table(spark, "wl_rules")
    assert sinks.active_rules(spark.table("wl_rules")).count() == 0
    spark.sql("DROP TABLE wl_rules")


def test_partitioned_sink_appends(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1 + i % 2), i) for i in range(10)], "event_time timestamp_ntz, n int")
    for _ in range(2):
        sinks.append_audit(df, f"{tmp_path}/audit")
    back = spark.read.parquet(f"{tmp_path}/audit")
    assert back.count() == 20
    one = back.filter("event_date = '2024-01-02'")
    assert one.count() == 10 and "PartitionFilters: [isnotnull(event_date" in plan(one)


def test_range_is_pushed_and_year_is_not(spark):
    o = table(spark, FOLDER, "orders")
    ranged = plan(o.filter(r.date_range(F.col("o_orderdate"), "year", dt.date(1997, 1, 1))).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in ranged and "LessThan(o_orderdate" in ranged
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in ranged
    assert "GreaterThanOrEqual(o_orderdate" not in plan(o.filter(F.year("o_orderdate") == 1997))


def test_in_list_is_pushed(spark):
    o = table(spark, FOLDER, "orders")
    assert "In(o_orderpriority" in plan(o.filter(r.any_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "5-LOW"])))


def test_not_in_needs_no_broadcast_of_the_list(spark):
    left = spark.range(100).withColumn("k", F.col("id"))
    right = spark.range(50).select(F.col("id").alias("r"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(r.not_in_null_aware(left, right, "k", "r"))
        assert "LeftAnti" in p and "NestedLoop" not in p and "Cartesian" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cross_product_in_temporal_joins(spark):
    from workloom.plans.registry import QUERIES

    for name in ("J1_cluster_as_of", "A1_runtime_utilisation", "K6_selected_sections", "W9_top_sections"):
        p = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name


def test_not_in_with_empty_right_keeps_nulls(spark):
    left = spark.createDataFrame([(1, None), (2, 5)], "id int, k int")
    empty = spark.createDataFrame([], "r int")
    assert {x.id for x in r.not_in_null_aware(left, empty, "k", "r").collect()} == {1, 2}


def test_merge_actions(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, v string, w int")
    s = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", 1)], "k int, v string, w int")
    for by_hash in (False, True):
        got = {x.k: (x.w, x.action) for x in r.merge(t, s, ["k"], ["v", "w"], by_hash).collect()}
        assert got == {1: (None, "unchanged"), 2: (None, "update"), 3: (1, "keep"), 4: (1, "insert")}


@pytest.mark.parametrize("given,want", [
    ("61GB", 61.0), ("8 GB", 8.0), ("1024MB", 1.0), ("2TB", 2048.0), ("junk", None)])
def test_memory(spark, given, want):
    assert spark.range(1).select(metrics.memory_gb(F.lit(given)).alias("x")).first().x == want


def test_cost_formula(spark):
    """45 s on 4 workers of i3.2xlarge, all-purpose: 2.0 * 3 * 5 * 0.1 / 80."""
    row = spark.range(1).select(
        metrics.run_cost(metrics.hourly_cost(metrics.node_rate(F.lit("i3.2xlarge"), F.lit(None).cast("string")), F.lit("all_purpose"), F.lit(4)), F.lit(45000)).alias("cost"),
        metrics.node_rate(F.lit("eu.m5.xlarge"), F.lit("1GB")).alias("region"),
        metrics.node_rate(F.lit("Standard_c5_9xlarge"), F.lit("1GB")).alias("loose"),
        metrics.node_rate(F.lit("x1.big"), F.lit("100GB")).alias("memory"),
        metrics.node_rate(F.lit("x1.big"), F.lit("?")).alias("nothing"),
    ).first()
    assert abs(row.cost - 0.0375) < 1e-12
    assert (row.region, row.loose, row.memory, row.nothing) == (1.38, 9.0, 25.0, 2.0)


def test_waste_note_with_a_baseline_of_zero(spark):
    rows = spark.createDataFrame([(2500, 1000), (5, 0), (0, 0), (None, 0), (5, None)], "actual bigint, best bigint")
    got = [r.note for r in rows.select(metrics.waste_text(F.col("actual"), F.col("best")).alias("note")).collect()]
    assert got == ["takes 2.5x longer than optimal (2s vs 1s)", "takes infx longer than optimal (0s vs 0s)", "already at its best", None, None]


def test_names_and_comments(spark):
    row = spark.range(1).select(
        names.full_table_name(F.lit("customers")).alias("a"), names.full_table_name(F.lit("sales.orders")).alias("b"),
        names.full_table_name(F.lit("a.b.c.d")).alias("c"), names.reference_problem(F.lit("main.select.x")).alias("d"),
        text.strip_comments(F.lit("SELECT 1 -- a\n/* b\n c */ FROM t  \n")).alias("e"),
    ).first()
    assert row.asDict() == {"a": "main.default.customers", "b": "main.sales.orders", "c": None, "d": "reserved word", "e": "SELECT 1\n FROM t"}


@pytest.mark.parametrize("name", ["J1_cluster_as_of", "A12_cost_rollup"])
def test_history_is_read_once(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("events.parquet") == 1


@pytest.mark.parametrize(("master", "ok"), [("local[4]", True), ("local", True), ("yarn", False), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False)])
def test_no_folder_of_one_machine_on_a_cluster(master, ok):
    from types import SimpleNamespace

    from workloom.session import shared_folder

    named = {"spark.master": master}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: named.get(k, d)), sparkContext=SimpleNamespace(applicationId=f"app-{master}"))
    if ok:
        assert shared_folder(session).startswith("/tmp/run-")
    else:
        with pytest.raises(RuntimeError):
            shared_folder(session)
    named["spark.checkpoint.dir"] = "hdfs:///shared"
    assert shared_folder(session) == "hdfs:///shared"
