"""Context text per statement: violations, metrics with ratings, cluster, table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.functions.formats import fixed


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"  <{name}>"), value, F.lit(f"</{name}>"))


def rendered(df: DataFrame) -> DataFrame:
    """Needs violations, ratings, cluster columns and ``schemas`` (array of table names)."""
    items = F.array_join(F.transform("violations", lambda v, i: F.concat(
        F.lit("    <violation n=\""), (i + 1).cast("string"), F.lit("\" rule=\""), v["rule_key"], F.lit("\" severity=\""),
        v["severity"], F.lit("\">"), escaped(v["message"]), F.lit("</violation>"))), "\n")
    found = F.when(F.size("violations") > 0, F.concat(
        F.lit("  <violations count=\""), F.size("violations").cast("string"), F.lit("\">\n"), items, F.lit("\n  </violations>")))
    ratings = F.concat_ws(
        "\n", tag("performance", F.col("performance")), tag("duration_seconds", fixed(F.col("execution_duration_ms") / 1000, 1)),
        tag("network", F.col("network")), tag("io", F.col("io")))
    cluster = F.when(F.col("cluster_id").isNotNull(), F.concat(
        F.lit("  <cluster type=\""), F.col("node_type"), F.lit("\" executors=\""), F.col("executor_count").cast("string"),
        F.lit("\" memory=\""), F.col("executor_memory"), F.lit("\" />")))
    schemas = F.when(F.size("schemas") > 0, tag("tables", F.array_join("schemas", ", ")))
    return df.select("statement_id", F.concat_ws("\n", F.lit("<context>"), found, ratings, cluster, schemas, F.lit("</context>")).alias("context"))
