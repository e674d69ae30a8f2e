"""Ranking that survives hot keys.

A plain window sorts one whole key in one task. Here a key is cut into buckets that follow
the sort order; each bucket is numbered on its own and shifted by the size of the buckets
before it, which is known from a small per-bucket count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys where null meets null, as it does in a grouping."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def row_number_by_bucket(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str = "rn",
) -> DataFrame:
    """row_number per key; ``bucket`` must not decrease along ``order``."""
    cut = df.withColumn("_bucket", bucket)
    upto = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .drop("_n")
    )
    local = cut.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    return (
        join_same(local, offsets, [*keys, "_bucket"])
        .withColumn(out, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .drop("_rn", "_offset", "_bucket")
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column, out: str = "rn") -> DataFrame:
    """The k first rows per key: first within (key, spread), then among the survivors."""
    first = W.partitionBy(*keys, "_part").orderBy(*order)
    survivors = (
        df.withColumn("_part", spread)
        .withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k).drop("_rn", "_part")
    )
    return survivors.withColumn(
        out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    ).filter(F.col(out) <= k)


def spread_by(*columns: str, parts: int = 16) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts))


def latest_per_key(df: DataFrame, keys: list[str], order: Column | list[Column]) -> DataFrame:
    """The row with the largest order value per key, by partial aggregation instead of a sort."""
    order = order if isinstance(order, list) else [order]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def previous_row(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], columns: list[str], out: str) -> DataFrame:
    """``lag`` of a struct of columns per key, without sorting a whole key in one task.

    Inside a bucket it is a plain lag; the first row of a bucket takes the last row of the
    bucket before it. ``bucket`` must not decrease along ``order``.
    """
    cut = df.withColumn("_bucket", bucket)
    row = F.struct(*columns)
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    ends = (
        cut.groupBy(*keys, "_bucket").agg(F.max_by(row, rank).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")))
        .drop("_last")
    )
    local = cut.withColumn("_prev", F.lag(row).over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    return join_same(local, ends, [*keys, "_bucket"], "left").withColumn(
        out, F.coalesce("_prev", "_carried")).drop("_prev", "_carried", "_bucket")
