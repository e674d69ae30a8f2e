"""The rewrites that the anti-pattern advice recommends, as DataFrame operators."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workloom.operators.ranking import row_number_by_bucket
from workloom.session import shared_folder

FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "<>": "<>"}


def compare(left: Column, op: str, right) -> Column:
    right = right if isinstance(right, Column) else F.lit(right)
    return {
        "=": lambda: left == right, "<>": lambda: left != right, "<": lambda: left < right,
        "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right,
    }[op]()


def _month_start(year: int, month: int) -> dt.date:
    return dt.date(year + (month - 1) // 12, (month - 1) % 12 + 1, 1)


def date_range(column: Column, unit: str, start: dt.date) -> Column:
    """``YEAR(c) = y`` and its kin as a half-open range on the bare column."""
    if unit == "year":
        end = dt.date(start.year + 1, 1, 1)
    elif unit == "quarter":
        end = _month_start(start.year, start.month + 3)
    elif unit == "month":
        end = _month_start(start.year, start.month + 1)
    elif unit == "day":
        end = start + dt.timedelta(days=1)
    else:
        raise ValueError(unit)
    low, high = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in (start, end))
    return (column >= low) & (column < high)


def isolate(column: Column, arithmetic: str, operand: float, op: str, literal: float) -> Column:
    """``column <arithmetic> operand <op> literal`` with the column alone on the left.

    A negative factor flips the comparison. Modulo has no inverse and keeps its expression,
    to be stored as a column of its own when it is filtered often.
    """
    if arithmetic == "+":
        return compare(column, op, literal - operand)
    if arithmetic == "-":
        return compare(column, op, literal + operand)
    if arithmetic == "*":
        return compare(column, op if operand > 0 else FLIP[op], literal / operand)
    if arithmetic == "/":
        return compare(column, op if operand > 0 else FLIP[op], literal * operand)
    if arithmetic == "%":
        return compare(column % operand, op, literal)
    raise ValueError(arithmetic)


def prefix_is(column: Column, prefix: str) -> Column:
    """``SUBSTRING(c, 1, n) = 'prefix'``"""
    return column.startswith(prefix)


def outside(column: Column, bound: float) -> Column:
    """``ABS(c) > bound``"""
    return (column > bound) | (column < -bound)


def whole_part_is(column: Column, value: int) -> Column:
    """``CAST(c AS INT) = value``; the cast cuts towards zero."""
    if value > 0:
        return (column >= value) & (column < value + 1)
    if value < 0:
        return (column > value - 1) & (column <= value)
    return (column > -1) & (column < 1)


def project(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*wanted)


def projection_report(df: DataFrame, wanted: list[str]) -> DataFrame:
    """(column_name, kept, n_values): which columns a projection keeps, and how many values each holds."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in wanted).alias("kept"), F.col(f"`{c}`").alias("n_values")) for c in df.columns])
    return counts.select(F.inline(rows))


def write_partitioned(spark: SparkSession, df: DataFrame, by: dict[str, Column]) -> str:
    """Write a partitioned copy below the shared folder and return its path; large partitions are
    split by bytes."""
    path = f"{shared_folder(spark)}/partitioned-{uuid.uuid4().hex}"
    keyed = df.withColumns(by)
    keyed.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
    return path


def read_pruned(spark: SparkSession, path: str, partitions: dict[str, object], needed: list[str]) -> DataFrame:
    """Read with every partition column filtered; a missing filter is an error."""
    df = spark.read.parquet(path)
    listed = {c for c in df.columns if c not in needed and c in partitions}
    if listed != set(partitions):
        raise ValueError("filter names a column that is not a partition column")
    for column, value in partitions.items():
        df = df.filter(F.col(column) == value)
    return df.select(*needed)


def any_of(column: Column, values: list) -> Column:
    return column.isin(*values)


def typed_equal(df: DataFrame, column: str, literal: str) -> DataFrame:
    """Compare a column with a literal cast to the column's own type."""
    return df.filter(F.col(column) == F.lit(literal).cast(df.schema[column].dataType))


def keyed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right, left[left_key] == right[right_key])


def ordered_keys(profile: dict[str, int], keys: list[str]) -> list[str]:
    """Keys from few to many distinct values; unknown ones sit in the middle."""
    known = sorted(profile.get(k, 0) for k in keys if k in profile)
    middle = known[len(known) // 2] if known else 0
    return sorted(keys, key=lambda k: profile.get(k, middle))


def distinct_unless_unique(df: DataFrame, key: str, is_unique: bool) -> DataFrame:
    return df.select(key) if is_unique else df.select(key).distinct()


def with_aggregate(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str,
                   aggregates: dict[str, Column], zero: tuple[str, ...] = ()) -> DataFrame:
    """A correlated aggregate as a left join on the pre-aggregated inner side."""
    per_key = inner.groupBy(F.col(inner_key).alias(outer_key)).agg(
        *[c.alias(name) for name, c in aggregates.items()]
    )
    joined = outer.join(per_key, outer_key, "left")
    return joined.withColumns({z: F.coalesce(z, F.lit(0)) for z in zero}) if zero else joined


def distinct_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def distinct_counts_approx(df: DataFrame, keys: list[str], columns: list[str], rsd: float = 0.02) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.approx_count_distinct(c, rsd).alias(f"n_{c}") for c in columns])


def distinct_counts_split(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One aggregate per column, joined on the keys: no expanded rows, more scans."""
    out = None
    for c in columns:
        one = df.groupBy(*keys).agg(F.count_distinct(c).alias(f"n_{c}"))
        out = one if out is None else out.join(one, keys)
    return out


def not_in_null_aware(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """SQL ``NOT IN`` without a broadcast: empty if the right side holds a null.

    A null on the left only survives an empty right side.
    """
    facts = right.agg(
        F.count("*").alias("n"), F.count(F.when(F.col(other).isNull(), 1)).alias("nulls")
    )
    has_null = facts.select(F.col("nulls") > 0).scalar()
    is_empty = facts.select(F.col("n") == 0).scalar()
    kept = left.join(right.filter(F.col(other).isNotNull()), left[key] == right[other], "left_anti")
    return kept.filter(~has_null & (F.col(key).isNotNull() | is_empty))


def not_exists(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """``NOT EXISTS``: nulls on either side never match."""
    return left.join(right, left[key] == right[other], "left_anti")


def not_in_filtered(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """``NOT IN`` over the non-null right values; a null on the left drops out."""
    return not_exists(left, right.filter(F.col(other).isNotNull()), key, other).filter(
        F.col(key).isNotNull()
    )


def not_in_list(df: DataFrame, key: str, values: list, keep_nulls: bool = True) -> DataFrame:
    outside_list = ~F.col(key).isin(*values)
    return df.filter(outside_list | F.col(key).isNull()) if keep_nulls else df.filter(outside_list)


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    return row_number_by_bucket(df, keys, bucket, order)


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_distinct(*parts: DataFrame) -> DataFrame:
    return union_all(*parts).distinct()


def merge(target: DataFrame, source: DataFrame, keys: list[str], compared: list[str],
          by_hash: bool = False) -> DataFrame:
    """New snapshot of the target with an action per row.

    insert: key only in the source; update: a compared column differs (null-safe);
    unchanged: same values, the target row is kept; keep: key only in the target.
    The source must hold one row per key. ``by_hash`` compares one hash over the columns.
    """
    values = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*values).alias("t"))
    s = source.select(*keys, F.struct(*values).alias("s"))
    both = t.join(s, keys, "full_outer")
    if by_hash:
        def digest(side: str) -> Column:
            cells = [F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("\u0000")) for c in compared]
            return F.sha2(F.concat_ws("\u0001", *cells), 256)
        differs = digest("t") != digest("s")
    else:
        differs = F.lit(False)
        for c in compared:
            differs = differs | ~F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    action = (
        F.when(F.col("t").isNull(), "insert").when(F.col("s").isNull(), "keep")
        .when(differs, "update").otherwise("unchanged")
    )
    picked = F.when(F.col("action").isin("insert", "update"), F.col("s")).otherwise(F.col("t"))
    return (
        both.withColumn("action", action).withColumn("row", picked)
        .select(*keys, *[F.col(f"row.{c}").alias(c) for c in values], "action")
    )


def merge_summary(merged: DataFrame) -> DataFrame:
    """Rows per action, and how many rewrites an unconditional update would add."""
    return merged.agg(
        F.count(F.when(F.col("action") == "insert", 1)).alias("inserted"),
        F.count(F.when(F.col("action") == "update", 1)).alias("updated"),
        F.count(F.when(F.col("action").isin("update", "unchanged"), 1)).alias("unconditional_updates"),
        F.count(F.when(F.col("action") == "unchanged", 1)).alias("rewrites_avoided"),
        F.count(F.when(F.col("action") == "keep", 1)).alias("untouched"),
    )
