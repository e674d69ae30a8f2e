"""Greedy selection under a token budget, exact and without sorting a group in one task.

Both passes rest on a bound for the rows that can matter:

* stop at the first overflow: each taken row with tokens costs at least one, so the first
  ``budget + 1`` rows with tokens hold the overflowing row. Everything ordered before it is
  taken, rows without tokens included.
* skip what does not fit: the room only shrinks, so of all rows of one size the taken ones
  are the first in order, at most ``budget / size`` of them. Those candidates are few
  (about budget * ln(budget) per group) whatever the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workloom.operators.ranking import join_same, spread_by


def _first_rows(df: DataFrame, keys: list[str], order: str, limit: Column, row_id: list[str]) -> DataFrame:
    """Rows with row_number <= limit per key; a hot key is thinned out in parts first."""
    thin = (
        df.withColumn("_part", spread_by(*row_id))
        .withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(order)))
        .filter(F.col("_rn") <= limit).drop("_part", "_rn")
    )
    return thin.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter(
        F.col("_rn") <= limit).drop("_rn")


def take_until_overflow(
    df: DataFrame, groups: list[str], order: Column, tokens: str, row_id: list[str],
    budget: int, used: DataFrame | None = None,
) -> DataFrame:
    """The longest prefix per group, in ascending ``order``, whose token sum fits.

    ``order`` must be unique within a group. ``used`` (groups, used_tokens) lowers the budget.
    """
    rows = df.withColumn("_order", order)
    costly = rows.filter(F.col(tokens) > 0).select(*groups, "_order", tokens, *row_id)
    near = _first_rows(costly, groups, "_order", F.lit(budget + 1), row_id)
    running = near.withColumn("_sum", F.sum(tokens).over(
        W.partitionBy(*groups).orderBy("_order").rowsBetween(W.unboundedPreceding, 0)))
    if used is not None:
        running = join_same(running, used, groups, "left")
        room = F.lit(budget) - F.coalesce("used_tokens", F.lit(0))
    else:
        room = F.lit(budget)
    cut = running.filter(F.col("_sum") > room).groupBy(*groups).agg(F.min("_order").alias("_cut"))
    return join_same(rows, cut, groups, "left").filter(
        F.col("_cut").isNull() | (F.col("_order") < F.col("_cut"))).drop("_order", "_cut")


def take_what_fits(
    df: DataFrame, groups: list[str], order: Column, tokens: str, row_id: list[str], budget: int,
) -> DataFrame:
    """Rows per group that a pass in ascending ``order`` takes when it skips what does not fit."""
    rows = df.withColumn("_order", order)
    small = rows.filter(F.col(tokens).between(1, budget)).select(*groups, "_order", tokens, *row_id)
    candidates = _first_rows(small, [*groups, tokens], "_order", F.floor(F.lit(budget) / F.col(tokens)), row_id)
    ordered = candidates.groupBy(*groups).agg(F.array_sort(F.collect_list(
        F.struct("_order", F.col(tokens).cast("bigint").alias("t"), F.struct(*row_id).alias("id")))).alias("items"))
    id_type = ordered.schema["items"].dataType.elementType["id"].dataType
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{id_type.simpleString()}>").alias("ids"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["used"] + item["t"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + item["t"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["ids"], F.array(item["id"]))).otherwise(acc["ids"]).alias("ids"))

    chosen = ordered.select(*groups, F.explode(F.aggregate("items", start, step)["ids"]).alias("id")).select(
        *groups, *[F.col(f"id.{c}").alias(c) for c in row_id])
    keys = list(dict.fromkeys([*groups, *row_id]))
    free = rows.filter(F.col(tokens) == 0).drop("_order")
    return join_same(df, chosen.select(*keys), keys, "left_semi").unionByName(free.select(*df.columns))
