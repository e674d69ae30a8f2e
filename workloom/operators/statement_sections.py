"""Guideline sections chosen for the statement at hand, for all statements at once.

Statements that name the same tables get the same sections, so work is done per distinct set of tables.
An inverted index leads from a table name to the sections whose code mentions it; only these get a
better score. All other sections rank alike for every statement, in one common list.

Per table and for the common list only sections that can be taken are kept: of one size the first
budget / size critical ones, and of all those whose predecessors in order do not use up twice the
budget (a pass over the critical ones may take a budget's worth before). A section that ranks among
the first m for some set of tables ranks among the first m of the common list or of one of its tables,
since a shared table only moves sections ahead. So lists are of bounded length, however many sections
mention a table, and the greedy choice per set needs the common list (sent to the tasks) and the
lists of its own tables. Sections without tokens have nothing to show and are not chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workloom.operators.budget import _first_rows
from workloom.session import written

SHARED, CODE = 15, 5
CRITICAL = 10


def table_sets(statements: DataFrame, tables_by_text: DataFrame, text_key) -> DataFrame:
    """(tables, statements): every distinct sorted list of lower-cased table names, and its statements."""
    runs = statements.groupBy(text_key.alias("text_key")).agg(F.count("*").alias("n"))
    low = F.array_sort(F.array_distinct(F.transform("tables", F.lower)))
    return runs.join(tables_by_text, "text_key").groupBy(low.alias("tables")).agg(F.sum("n").alias("statements"))


def scored_sections(described: DataFrame, row_id: list[str]) -> DataFrame:
    """Sections with the score they have for statements that share no table with them."""
    score = F.col("priority") - F.when(F.size("code_blocks") > 0, CODE).otherwise(0)
    return described.select(*row_id, "priority", "tokens", "affected_tables", score.alias("score"))


def index_by_table(scored: DataFrame, row_id: list[str]) -> DataFrame:
    """(table_name, section) with the score for a statement that names the table."""
    return scored.withColumn("table_name", F.explode_outer("affected_tables")).filter("table_name IS NOT NULL").select(
        "table_name", *row_id, "priority", "tokens", (F.col("score") - SHARED).alias("score"))


def overlaps(sets: DataFrame, scored: DataFrame, row_id: list[str]) -> DataFrame:
    """(tables, section, score) of all pairs that share a table.

    An inner explode would have Spark derive a filter on the array of tables and run the lexical analysis
    that finds it on every statement of the history, below the grouping."""
    named = sets.select("tables", F.explode_outer("tables").alias("table_name")).filter("table_name IS NOT NULL")
    return named.join(index_by_table(scored, row_id), "table_name").drop("table_name").distinct()


def within_reach(rows: DataFrame, key: str, row_id: list[str], budget: int) -> DataFrame:
    """The rows per key that a choice under the budget can take."""
    rows = rows.filter("tokens > 0").withColumn("_order", F.struct("score", *row_id))
    critical = _first_rows(rows.filter((F.col("priority") <= CRITICAL) & (F.col("tokens") <= budget)), [key, "tokens"], "_order",
                           F.floor(F.lit(budget) / F.col("tokens")), row_id)
    near = _first_rows(rows, [key], "_order", F.lit(2 * budget + 1), row_id)
    before = F.sum("tokens").over(W.partitionBy(key).orderBy("_order").rowsBetween(W.unboundedPreceding, -1))
    near = near.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= 2 * budget).drop("_before")
    return critical.unionByName(near).distinct().drop("_order")


def choose(ranked: list[tuple], budget: int) -> list[tuple]:
    """(section, pass) of sections (score, section, priority, tokens) in order: critical ones that fit
    first, then the others up to the first that does not fit."""
    out, used, taken = [], 0, set()
    for _, row, priority, size in ranked:
        if priority <= CRITICAL and used + size <= budget:
            used += size
            taken.add(row)
            out.append((row, 1))
    for _, row, _, size in ranked:
        if row not in taken:
            if used + size > budget:
                break
            used += size
            out.append((row, 2))
    return out


def sections_for_statements(described: DataFrame, sets: DataFrame, row_id: list[str], budget: int = 2000) -> DataFrame:
    """(tables, statements, section, pass) for every set of tables."""
    scored = written(scored_sections(described, row_id))
    columns = [*row_id, "priority", "tokens", "score"]
    common = within_reach(scored.select(F.lit("").alias("_all"), *columns), "_all", row_id, budget).drop("_all")
    lists = within_reach(index_by_table(scored, row_id), "table_name", row_id, budget)
    # At most budget * ln(budget) + 2 * budget sections.
    sent = described.sparkSession.sparkContext.broadcast([
        (r["score"], tuple(r[c] for c in row_id), r["priority"], r["tokens"]) for r in common.collect()])
    item = F.struct("score", F.struct(*row_id).alias("row"), "priority", "tokens")
    own = sets.select("tables", "statements", F.explode_outer("tables").alias("table_name")).join(lists, "table_name", "left").groupBy(
        "tables", "statements").agg(F.collect_set(F.when(F.col("tokens").isNotNull(), item)).alias("own"))
    kinds = {f.name: f.dataType.simpleString() for f in described.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mine = [(x["score"], tuple(x["row"].values()), x["priority"], x["tokens"]) for x in r["own"]]
                shared = {x[1] for x in mine}
                ranked = sorted(mine + [x for x in sent.value if x[1] not in shared])
                out += [{"tables": r["tables"], "statements": r["statements"], **dict(zip(row_id, row)), "pass": n}
                        for row, n in choose(ranked, budget)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("tables", pa.list_(pa.string())), ("statements", pa.int64()),
                        *[(c, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kinds[c]]) for c in row_id], ("pass", pa.int32())])
    return own.mapInArrow(work, "tables array<string>, statements bigint, " + ", ".join(f"{c} {kinds[c]}" for c in row_id) + ", pass int")
