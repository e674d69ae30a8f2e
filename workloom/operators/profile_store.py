"""Profiles of tables as mergeable states, written once per partition and read by version.

A state is one row per (table, partition, column): rows, nulls, declared type, a HyperLogLog sketch,
and for key columns the exact number of distinct values with the lowest and the highest one. Rows,
nulls and sketches of partitions add up, so a new partition is profiled alone and its states are
appended under a new version; a partition that is profiled again replaces its older states. Readers
name a version and see what was written up to it; they never scan the profiled table.

A key column is proven unique if it has no nulls, no partition repeats a value, and the partitions'
ranges of values do not meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LG_K = 12
#: Relative standard error of a sketch of 2**LG_K registers.
STANDARD_ERROR = 1.04 / 2 ** (LG_K / 2)
SCHEMA = (
    "version int, table_name string, partition_column string, partition_value string, column_name string, data_type string, "
    "rows bigint, nulls bigint, sketch binary, distinct_values bigint, low_number decimal(38,6), high_number decimal(38,6), "
    "low_text string, high_text string")


def _sketched(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    return F.col(column) if kind in ("int", "bigint", "string", "binary") else F.col(column).cast("string")


def states(
    df: DataFrame, table_name: str, columns: list[str], partition: str | None = None, keys: tuple[str, ...] = (),
    value: Column | None = None,
) -> DataFrame:
    """States of the columns per partition (or one for the whole table): one pass for all of them, and one per
    key column for its distinct values, so that no value of a key carries the sketches of all columns.

    ``partition`` names the column the table is laid out by, ``value`` how (its value, by default).
    """
    part = F.lit(None) if partition is None else F.col(partition) if value is None else value
    own = df.withColumn("_part", part.cast("string"))
    out: list[Column] = [F.count("*").alias("_rows")]
    for c in columns:
        out += [F.count(c).alias(f"_n_{c}"), F.hll_sketch_agg(_sketched(df, c), LG_K).alias(f"_s_{c}")]
    for c in keys:
        out += [F.min(c).alias(f"_l_{c}"), F.max(c).alias(f"_h_{c}")]
    per = own.groupBy("_part").agg(*out)
    for c in keys:
        values = own.filter(F.col(c).isNotNull()).select(F.col("_part").alias("_p"), F.col(c).alias("_v")).distinct()
        per = per.join(values.groupBy("_p").agg(F.count("*").alias("_d")), F.col("_part").eqNullSafe(F.col("_p")), "left")
        per = per.withColumn(f"_d_{c}", F.coalesce("_d", F.lit(0))).drop("_p", "_d")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    number = lambda c: kinds[c].startswith(("int", "bigint", "smallint", "tinyint", "decimal"))

    def limit(c: str, end: str, as_number: bool) -> Column:
        kind = "decimal(38,6)" if as_number else "string"
        return (F.col(f"_{end}_{c}") if c in keys and number(c) == as_number else F.lit(None)).cast(kind)

    rows = [F.struct(
        F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.col("_rows").alias("rows"),
        (F.col("_rows") - F.col(f"_n_{c}")).alias("nulls"), F.col(f"_s_{c}").alias("sketch"),
        (F.col(f"_d_{c}") if c in keys else F.lit(None).cast("bigint")).alias("distinct_values"),
        limit(c, "l", True).alias("low_number"), limit(c, "h", True).alias("high_number"),
        limit(c, "l", False).alias("low_text"), limit(c, "h", False).alias("high_text")) for c in columns]
    return per.select(
        F.lit(table_name).alias("table_name"), F.lit(partition).cast("string").alias("partition_column"),
        F.col("_part").alias("partition_value"), F.explode(F.array(*rows)).alias("x"),
    ).select("table_name", "partition_column", "partition_value", "x.*")


def append(found: DataFrame, path: str, version: int) -> None:
    """Write states under a version; writing a version again replaces it."""
    found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")


def read(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The states as of a version: per partition and column the newest ones up to it."""
    columns = SCHEMA.split(", ", 1)[1]
    every = spark.read.schema(f"{columns}, version int").parquet(path).filter(F.col("version") <= version)
    newest = W.partitionBy("table_name", "partition_value", "column_name").orderBy(F.desc("version"))
    return every.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def merged(found: DataFrame) -> DataFrame:
    """One row per table and column: rows, nulls, type, estimated distinct values, proven uniqueness."""
    order = W.partitionBy("table_name", "column_name").orderBy("low_number", "low_text")
    apart = F.coalesce(F.lag("high_number").over(order) < F.col("low_number"), F.lag("high_text").over(order) < F.col("low_text"),
                       F.row_number().over(order) == 1)
    alone = (F.col("nulls") == 0) & (F.col("distinct_values") == F.col("rows"))
    return found.withColumn("_apart", apart).groupBy("table_name", "column_name").agg(
        F.max("data_type").alias("data_type"), F.max("partition_column").alias("partition_column"),
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"),
        F.bool_and(F.coalesce(alone & F.col("_apart"), F.lit(False))).alias("is_unique"))


def partition_columns(profiles: DataFrame) -> DataFrame:
    """(table_name, column_name) of the columns that tables are laid out by."""
    return profiles.filter("partition_column IS NOT NULL").select("table_name", F.col("partition_column").alias("column_name")).distinct()


def unique_columns(profiles: DataFrame) -> DataFrame:
    return profiles.filter("is_unique").select("table_name", "column_name")


def column_types(profiles: DataFrame) -> DataFrame:
    return profiles.select("table_name", "column_name", "data_type")
