"""Table and identifier names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that may not be used as identifiers.
RESERVED_WORDS = (
    "select", "from", "where", "insert", "update", "delete", "drop", "create", "alter",
    "table", "database", "schema", "union", "join", "and", "or", "not", "null", "true", "false",
)


def full_table_name(name: Column, catalog: str = "main", schema: str = "default") -> Column:
    parts = F.size(F.split(name, r"\."))
    return (
        F.when(parts == 3, name)
        .when(parts == 2, F.concat(F.lit(f"{catalog}."), name))
        .when(parts == 1, F.concat(F.lit(f"{catalog}.{schema}."), name))
    )


def is_system_table(name: Column) -> Column:
    return name.startswith("system.")


def identifier_problem(name: Column) -> Column:
    """Why a bare identifier is unsafe; null when it is fine."""
    clean = F.replace(name, F.lit("`"), F.lit(""))
    return (
        F.when(name.isNull() | (name == ""), "empty")
        .when(~clean.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), "invalid characters")
        .when(F.lower(clean).isin(*RESERVED_WORDS), "reserved word")
        .when(F.length(clean) > 255, "too long")
    )


def reference_problem(name: Column) -> Column:
    """Why a dotted table reference is unsafe: too many parts, or its first bad part."""
    parts = F.split(name, r"\.")
    reasons = F.array_compact(F.transform(parts, identifier_problem))
    return (
        F.when(name.isNull() | (name == ""), "empty")
        .when(F.size(parts) > 3, "more than three parts")
        .when(F.size(reasons) > 0, reasons[0])
    )
