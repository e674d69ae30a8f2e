"""Keyed tables that are merged in place of files: only what changes is written.

A table lies in buckets of its key's hash, below ``data/gen=…/bucket=…``. A manifest per version names,
for every bucket, the generation that holds it, its rows, and the sum of their hashes. A merge reads only the
buckets that incoming rows fall into, writes only those in which a row is new or differs, and then
the manifest of the next version; buckets without a change keep their files, and a merge that changes nothing
writes nothing. Changed rows go to a log, ``log/version=…``, with their action and former values.

The manifest is written last, as one file, so readers see a merge whole or not at all, and a merge that broke
off is written over by the next one. Former versions stay readable. One writer per table at a time. The number of
buckets is given once, at creation; the manifest's rows, as many as buckets, are all that reaches the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workloom.session import written

MANIFEST = "bucket int, gen int, n bigint, digest decimal(38,0), buckets int, version int"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _row_hash(columns: list[str]) -> Column:
    """Sum of row hashes; a null is told from an absent column by its place."""
    cells = [F.struct(F.lit(k), F.col(c).isNull(), F.col(c)) for k, c in enumerate(columns)]
    return F.sum(F.xxhash64(*cells).cast("decimal(38,0)"))


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def version(spark: SparkSession, path: str) -> int:
    """The newest version; 0 where there is no table."""
    every = _manifests(spark, path)
    return 0 if every is None else every.agg(F.max("version")).first()[0] or 0


def manifest(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """(bucket, gen, n, digest, buckets, version) of a version, the newest one unless named."""
    every = _manifests(spark, path)
    if every is None:
        raise ValueError(f"no merged table at {path}")
    return every.filter(F.col("version") == (version(spark, path) if at is None else at))


def _held(spark: SparkSession, path: str, places: dict[int, list[int]]) -> DataFrame:
    """Rows of the given buckets by generation. The filter is on folders, so no other file is opened."""
    here = F.lit(False)
    for gen, buckets in places.items():
        here = here | ((F.col("gen") == gen) & F.col("bucket").isin(buckets))
    return spark.read.option("mergeSchema", "false").parquet(f"{path.rstrip('/')}/data").filter(here)


def _places(rows) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["gen"], []).append(r["bucket"])
    return out


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The table as of a version, without the columns of the layout."""
    return _held(spark, path, _places(manifest(spark, path, at).collect())).drop("gen", "bucket")


def log(spark: SparkSession, path: str) -> DataFrame:
    """Every inserted or updated row: key, action, values, former values (``before``), version."""
    return spark.read.parquet(f"{path.rstrip('/')}/log")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """Buckets of the newest version whose rows are not those that the manifest counted and hashed."""
    known = manifest(spark, path)
    rows = _held(spark, path, _places(known.collect()))
    columns = [c for c in rows.columns if c not in ("gen", "bucket")]
    found = rows.groupBy("bucket").agg(F.count("*").alias("found"), _row_hash(columns).alias("now"))
    return known.join(found, "bucket", "left").filter(
        ~(F.col("n").eqNullSafe(F.col("found")) & F.col("digest").eqNullSafe(F.col("now")))).select("bucket", "n", "found")


def _checked(source: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows, written once; null or repeated keys are refused, as a merge could not place them."""
    rows = written(source)
    bare = F.lit(False)
    for k in keys:
        bare = bare | F.col(k).isNull()
    if rows.filter(bare).limit(1).count():
        raise ValueError(f"rows to merge hold a null in {', '.join(keys)}")
    if rows.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"rows to merge hold a key of {', '.join(keys)} twice")
    return rows


def _commit(rows: DataFrame, spark: SparkSession, path: str, gen: int, buckets: int, columns: list[str], stay) -> None:
    """Write buckets as a generation, then the manifest of the version of that number."""
    place = f"{path.rstrip('/')}/data/gen={gen}"
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
    fresh = spark.read.schema(rows.schema).parquet(place).groupBy("bucket").agg(
        F.count("*").alias("n"), _row_hash(columns).alias("digest")).select(
        "bucket", F.lit(gen).alias("gen"), "n", "digest", F.lit(buckets).alias("buckets"))
    every = fresh if stay is None else fresh.unionByName(
        stay.join(fresh.select("bucket"), "bucket", "left_anti").select("bucket", "gen", "n", "digest", "buckets"))
    every.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest/version={gen}")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Version 1 of a table with one row per key, and one row at least."""
    spark = rows.sparkSession
    if version(spark, path):
        raise ValueError(f"there is a merged table at {path}")
    held = _checked(rows, keys)
    if held.isEmpty():
        raise ValueError("a merged table begins with a row at least")
    _commit(held.withColumn("bucket", _bucket(keys, buckets)), spark, path, 1, buckets, held.columns, None)


def merge_into(source: DataFrame, path: str, keys: list[str], compared: list[str] | None = None) -> dict[str, int]:
    """Merge rows into a table: new keys are inserted, rows that differ in a compared column (null-safe)
    are replaced, others stay. Returns rows per action, buckets read and written, and the version after it.
    """
    spark = source.sparkSession
    known = manifest(spark, path)
    entries = known.collect()
    gen, buckets = entries[0]["version"] + 1, entries[0]["buckets"]
    incoming = _checked(source, keys).withColumn("bucket", _bucket(keys, buckets))
    touched = {r["bucket"] for r in incoming.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
    target = _held(spark, path, _places(r for r in entries if r["bucket"] in touched)).drop("gen")
    columns = [c for c in target.columns if c != "bucket"]
    values = [c for c in columns if c not in keys]
    differs = F.lit(False)
    for c in compared or values:
        differs = differs | ~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    action = (F.when(F.col("t").isNull(), "insert").when(F.col("s").isNull(), "keep")
              .when(differs, "update").otherwise("unchanged"))
    both = target.select("bucket", *keys, F.struct(F.lit(1).alias("_is"), *values).alias("t")).join(
        incoming.select("bucket", *keys, F.struct(F.lit(1).alias("_is"), *values).alias("s")), ["bucket", *keys], "full_outer")
    merged = written(both.withColumn("action", action))
    tally = {(r["bucket"], r["action"]): r["count"] for r in merged.groupBy("bucket", "action").count().collect()}
    changed = sorted({b for b, a in tally if a in ("insert", "update")})
    counts = {a: sum(n for (_, x), n in tally.items() if x == a) for a in ("insert", "update", "unchanged")}
    if changed:
        new = F.col("action").isin("insert", "update")
        after = [F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in values]
        moved = merged.filter(new).select(
            *keys, "action", *[F.col(f"s.{c}").alias(c) for c in values], F.when(F.col("t").isNotNull(), F.struct(
                *[F.col(f"t.{c}").alias(c) for c in values])).alias("before"))
        moved.write.mode("overwrite").parquet(f"{path.rstrip('/')}/log/version={gen}")
        rows = merged.filter(F.col("bucket").isin(changed)).select(*keys, *after, "bucket").select(*columns, "bucket")
        _commit(rows, spark, path, gen, buckets, columns, written(known))
    return {**counts, "buckets_read": len(touched), "buckets_written": len(changed), "version": gen - (not changed)}
