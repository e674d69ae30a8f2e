"""Measured evidence for the advice: fan-out, cardinality, uniqueness, nulls, casts, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_fan_out(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Output rows of an equi-join and of a cross product, from per-key counts only."""
    nl = left.groupBy(key).agg(F.count("*").alias("n_left"))
    nr = right.groupBy(key).agg(F.count("*").alias("n_right"))
    per_key = nl.join(nr, key, "full_outer")
    n_l, n_r = F.coalesce("n_left", F.lit(0)), F.coalesce("n_right", F.lit(0))
    joined = F.sum(F.when(F.col(key).isNotNull(), n_l * n_r).otherwise(0))
    return per_key.agg(
        F.sum(n_l).alias("left_rows"), F.sum(n_r).alias("right_rows"),
        joined.alias("join_rows"), F.max(n_l * n_r).alias("largest_key_rows"),
    ).withColumns({
        "cross_rows": F.col("left_rows") * F.col("right_rows"),
        "blow_up": F.try_divide(
            F.col("left_rows").cast("double") * F.col("right_rows"), F.col("join_rows").cast("double")
        ),
    })


def fan_out_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    nl = left.groupBy(key).agg(F.count("*").alias("n_left"))
    nr = right.groupBy(key).agg(F.count("*").alias("n_right"))
    return nl.join(nr, key).withColumn("join_rows", F.col("n_left") * F.col("n_right"))


def _unpivot(row: DataFrame, columns: list[str], stats: list[str]) -> DataFrame:
    """One-row wide statistics to one row per column."""
    parts = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{s}__{c}").alias(s) for s in stats])
        for c in columns
    ]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def cardinality(df: DataFrame, columns: list[str], high_share: float = 0.1) -> DataFrame:
    """Exact distinct counts; a column is high when distinct/rows exceeds the share."""
    row = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"distinct_values__{c}") for c in columns])
    row = row.withColumns({f"rows__{c}": F.col("n") for c in columns})
    return _unpivot(row, columns, ["distinct_values", "rows"]).withColumn(
        "cardinality", F.when(F.col("distinct_values") / F.col("rows") > high_share, "high").otherwise("low")
    )


def cardinality_approx(df: DataFrame, columns: list[str], rsd: float = 0.02, high_share: float = 0.1) -> DataFrame:
    row = df.agg(F.count("*").alias("n"), *[
        F.approx_count_distinct(c, rsd).alias(f"distinct_values__{c}") for c in columns
    ])
    row = row.withColumns({f"rows__{c}": F.col("n") for c in columns})
    return _unpivot(row, columns, ["distinct_values", "rows"]).withColumn(
        "cardinality", F.when(F.col("distinct_values") / F.col("rows") > high_share, "high").otherwise("low")
    )


def approximation_error(df: DataFrame, columns: list[str], tolerance: float = 0.02) -> DataFrame:
    exact = cardinality(df, columns).select("column_name", F.col("distinct_values").alias("exact"))
    approx = cardinality_approx(df, columns, tolerance).select("column_name", F.col("distinct_values").alias("approx"))
    error = F.abs(F.col("approx") - F.col("exact")) / F.col("exact")
    return exact.join(approx, "column_name").withColumn("relative_error", error).withColumn(
        "within_tolerance", F.col("relative_error") <= tolerance
    )


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(F.count("*").alias("n"), *[
        e for c in columns for e in (
            F.count_distinct(c).alias(f"distinct_values__{c}"), F.count(c).alias(f"present__{c}")
        )
    ])
    row = row.withColumns({
        **{f"rows__{c}": F.col("n") for c in columns},
        **{f"nulls__{c}": F.col("n") - F.col(f"present__{c}") for c in columns},
    })
    return _unpivot(row, columns, ["rows", "distinct_values", "nulls"]).withColumn(
        "is_unique", (F.col("distinct_values") == F.col("rows")) & (F.col("nulls") == 0)
    )


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(F.count("*").alias("n"), *[
        F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls__{c}") for c in columns
    ]).withColumns({f"rows__{c}": F.col("n") for c in columns})
    return _unpivot(row, columns, ["nulls", "rows"]).withColumn("not_in_risk", F.col("nulls") > 0)


def cast_safety(df: DataFrame, column: str, target: str) -> DataFrame:
    """Values that fail the cast, and values that do not come back as they were."""
    cast = F.col(column).try_cast(target)
    return df.agg(
        F.count("*").alias("rows"),
        F.count(column).alias("present"),
        F.count(F.when(F.col(column).isNotNull() & cast.isNull(), 1)).alias("failed"),
        F.count(F.when(cast.cast("string") != F.col(column), 1)).alias("changed"),
    )


def union_duplicates(*branches: DataFrame) -> DataFrame:
    """Rows a distinct union removes: repeats within a branch and repeats across branches."""
    tagged = None
    for i, b in enumerate(branches):
        one = b.withColumn("_branch", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    columns = [c for c in tagged.columns if c != "_branch"]
    per_branch = tagged.groupBy(*columns, "_branch").agg(F.count("*").alias("n"))
    per_row = per_branch.groupBy(*columns).agg(F.sum("n").alias("n"), F.count("*").alias("branches"))
    return per_row.agg(
        F.sum("n").alias("all_rows"), F.count("*").alias("distinct_rows"),
        F.sum(F.col("n") - F.col("branches")).alias("repeats_within"),
        F.sum(F.col("branches") - 1).alias("repeats_across"),
    )


def partition_shares(df: DataFrame, partition: Column, wanted: Column) -> DataFrame:
    """Rows per partition and whether a filter on the partition would read it."""
    return df.groupBy(partition.alias("partition_value")).agg(F.count("*").alias("rows")).withColumn(
        "is_read", wanted
    )


def scanned_share(shares: DataFrame) -> DataFrame:
    return shares.agg(
        F.count("*").alias("partitions"), F.count(F.when(F.col("is_read"), 1)).alias("partitions_read"),
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("is_read"), F.col("rows")).otherwise(0)).alias("rows_read"),
    )


def files_per_partition(df: DataFrame, partition: str) -> DataFrame:
    return df.groupBy(partition).agg(
        F.count_distinct(F.input_file_name()).alias("files"), F.count("*").alias("rows")
    )
