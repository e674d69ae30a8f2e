"""Stored profiles: states merge, versions read back, and only proof counts as uniqueness."""

from pyspark.sql import functions as F

from workloom.operators import detectors, profile_store
from workloom.session import shared_folder

COLUMNS = ["id", "name", "day"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name string, day string")


def profile(spark, path, version):
    return {r["column_name"]: r for r in profile_store.merged(profile_store.read(spark, path, version)).collect()}


def test_partitions_are_added_and_replaced(spark, tmp_path):
    path = str(tmp_path)
    add = lambda rows, version: profile_store.append(
        profile_store.states(frame(spark, rows), "t", COLUMNS, "day", keys=("id", "name")), path, version)
    add([(k, f"n{k}", "d1") for k in range(100)], 1)
    add([(k, None if k % 2 else f"n{k}", "d2") for k in range(100, 300)], 2)
    add([(k, f"m{k}", "d1") for k in range(50, 150)], 3)
    one, two, three = (profile(spark, path, v) for v in (1, 2, 3))
    assert (one["id"]["rows"], two["id"]["rows"], three["id"]["rows"]) == (100, 300, 300)
    assert (one["name"]["nulls"], two["name"]["nulls"], three["name"]["nulls"]) == (0, 100, 100)
    assert one["name"]["is_unique"] and not two["name"]["is_unique"]
    # In version 3 both days have ids from 100 to 149: each is unique alone, the table is not proven to be.
    assert two["id"]["is_unique"] and not three["id"]["is_unique"] and not one["day"]["is_unique"]
    assert abs(two["id"]["distinct_estimate"] - 300) < 3 * profile_store.STANDARD_ERROR * 300 + 1
    assert {r["partition_column"] for r in two.values()} == {"day"} and two["id"]["data_type"] == "bigint"


def test_whole_tables_and_text_keys(spark, tmp_path):
    rows = [(1, "b", "x"), (2, "a", "x"), (3, "c", None)]
    profile_store.append(profile_store.states(frame(spark, rows), "t", COLUMNS, keys=("name",)), str(tmp_path), 1)
    found = profile(spark, str(tmp_path), 1)
    assert found["name"]["is_unique"] and found["day"]["nulls"] == 1 and found["id"]["partition_column"] is None
    assert profile_store.merged(profile_store.read(spark, str(tmp_path), 0)).count() == 0


def test_facts_decide_the_finding(spark, tmp_path):
    statements = spark.createDataFrame([("s", "u", "SELECT DISTINCT badge FROM main.hr.staff")], "statement_id string, executed_by string, statement_text string")
    staff = spark.createDataFrame([("a1",), ("a2",)], "badge string")
    for number, (df, hits) in enumerate(((staff, 1), (staff.union(staff), 0))):
        path = f"{tmp_path}/{number}"
        profile_store.append(profile_store.states(df, "main.hr.staff", ["badge"], keys=("badge",)), path, 1)
        uniques = profile_store.unique_columns(profile_store.merged(profile_store.read(spark, path, 1)))
        assert detectors.detect_statements(statements, ["DISTINCT_ON_UNIQUE"], uniques=uniques).count() == hits


def test_detection_does_not_read_the_table(spark):
    from workloom.plans.detection import profiled

    folder = "/root/testdata/sf0.001"
    assert shared_folder(spark)
    profiled(spark, folder).count()
    scans = [f for f in profiled(spark, folder).inputFiles()]
    assert scans and not any("/testdata/" in f for f in scans)
    assert profiled(spark, folder).filter(F.col("partition_column").isNotNull()).select("table_name").distinct().collect()[0][0] == "main.sales.lineitem"


def test_distinct_values_of_keys_are_counted_apart(spark):
    """Counting several keys beside the sketches would repeat all columns, sketches included, for every value of a key."""
    rows = [(1, "a", "d1"), (2, None, "d1"), (2, "b", "d1"), (3, None, None), (4, None, None)]
    found = profile_store.states(frame(spark, rows), "t", COLUMNS, "day", keys=("id", "name"))
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    counts = {(r["partition_value"], r["column_name"]): r["distinct_values"] for r in found.collect()}
    assert counts == {("d1", "id"): 2, ("d1", "name"): 2, ("d1", "day"): None, (None, "id"): 2, (None, "name"): 0, (None, "day"): None}
