"""Merged tables: only changed buckets are written, versions stay readable, bad sources are refused."""

from pathlib import Path

import pytest

from workloom.operators import merge_store

SCHEMA = "k bigint, name string, price double"


def rows(df):
    return sorted((r["k"], r["name"], r["price"]) for r in df.collect())


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*") if p.is_file()}


@pytest.fixture()
def store(spark, tmp_path):
    path = str(tmp_path)
    merge_store.create(spark.createDataFrame([(k, f"n{k}", k / 2) for k in range(200)], SCHEMA), path, ["k"], buckets=16)
    return path


def test_only_changed_buckets_are_written(spark, store):
    before = files(store)
    source = spark.createDataFrame([(7, "other", 3.5), (8, "n8", 4.0), (1000, None, None)], SCHEMA)
    done = merge_store.merge_into(source, store, ["k"])
    assert (done["insert"], done["update"], done["unchanged"], done["version"]) == (1, 1, 1, 2)
    assert done["buckets_read"] <= 3 and done["buckets_written"] <= 2
    after = files(store)
    assert all(after[f] == t for f, t in before.items())
    written = {Path(f).parent.name for f in after if "gen=2/bucket" in f}
    assert len(written) == done["buckets_written"]
    expected = {k: (k, f"n{k}", k / 2) for k in range(200)} | {7: (7, "other", 3.5), 1000: (1000, None, None)}
    assert {r[0]: r for r in rows(merge_store.read(spark, store))} == expected
    assert rows(merge_store.read(spark, store, 1)) == sorted((k, f"n{k}", k / 2) for k in range(200))
    moved = {r["k"]: (r["action"], r["before"] and r["before"]["name"]) for r in merge_store.log(spark, store).collect()}
    assert moved == {7: ("update", "n7"), 1000: ("insert", None)}


def test_a_repeated_merge_writes_nothing(spark, store):
    source = spark.createDataFrame([(7, None, 3.5), (300, "new", None)], SCHEMA)
    merge_store.merge_into(source, store, ["k"])
    before = files(store)
    again = merge_store.merge_into(source, store, ["k"])
    assert (again["unchanged"], again["buckets_written"], again["version"]) == (2, 0, 2) and files(store) == before


def test_uncompared_columns_alone_are_no_change(spark, store):
    done = merge_store.merge_into(spark.createDataFrame([(7, "other", 3.5)], SCHEMA), store, ["k"], ["price"])
    assert done["unchanged"] == 1 and done["version"] == 1


def test_an_empty_source_reads_no_bucket(spark, store):
    done = merge_store.merge_into(spark.createDataFrame([], SCHEMA), store, ["k"])
    assert done["buckets_read"] == 0 and done["version"] == 1


def test_a_merge_that_broke_off_is_written_over(spark, store):
    """Files of a generation without a manifest are not read, and the next merge takes its number."""
    stray = spark.createDataFrame([(7, "half", 0.0, 3)], SCHEMA + ", bucket int")
    stray.write.partitionBy("bucket").parquet(f"{store}/data/gen=2")
    assert len(rows(merge_store.read(spark, store))) == 200
    merge_store.merge_into(spark.createDataFrame([(500, "late", 1.0)], SCHEMA), store, ["k"])
    got = rows(merge_store.read(spark, store))
    assert len(got) == 201 and not [r for r in got if r[1] == "half"]


def test_bad_sources_are_refused(spark, store, tmp_path):
    for source in ([(1, "a", 0.0), (1, "b", 0.0)], [(None, "a", 0.0)]):
        with pytest.raises(ValueError):
            merge_store.merge_into(spark.createDataFrame(source, SCHEMA), store, ["k"])
    with pytest.raises(ValueError):
        merge_store.create(spark.createDataFrame([(1, "a", 0.0)], SCHEMA), store, ["k"])
    with pytest.raises(ValueError):
        merge_store.read(spark, str(tmp_path / "none"))


def test_damage_is_found(spark, store):
    assert merge_store.damaged(spark, store).count() == 0
    held = merge_store.manifest(spark, store).orderBy("bucket").first()
    stray = spark.createDataFrame([(1, "n1", 0.5)], SCHEMA)
    stray.write.mode("append").parquet(f"{store}/data/gen=1/bucket={held['bucket']}")
    assert [(r["bucket"], r["found"] - r["n"]) for r in merge_store.damaged(spark, store).collect()] == [(held["bucket"], 1)]
