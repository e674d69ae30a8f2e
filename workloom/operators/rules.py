"""Versioned rule tables: parsing, defaults, validation, latest version, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.operators.ranking import latest_per_key, previous_row
from workloom.operators.rewrites import merge

# Allowed entries of the enumerated rule fields.
CATEGORIES = ("universal", "context-dependent")
SEVERITIES = ("critical", "high", "medium", "low")
METHODS = ("AST", "pattern", "LLM", "query_plan")
SOURCE_RANK = {"built-in": 1, "yaml": 2, "table": 3}
ALLOWED_PREFIXES = ("workloom.detectors",)

METADATA = "confidence_score double, created_by string, approved_by string, version string"


def parse_json(rules: DataFrame) -> DataFrame:
    """Thresholds to a map and metadata to a struct; bad or non-object text is empty."""
    is_object = lambda c: F.col(c).rlike(r"(?s)^\s*\{.*\}\s*$")
    return rules.withColumns({
        "thresholds": F.coalesce(
            F.when(is_object("custom_thresholds"), F.from_json("custom_thresholds", "map<string,string>")),
            F.create_map().cast("map<string,string>")),
        "meta": F.when(is_object("metadata"), F.from_json("metadata", METADATA)),
    })


def fill_defaults(parsed: DataFrame) -> DataFrame:
    return parsed.withColumns({
        "created_by": F.coalesce("meta.created_by", "created_by"),
        "approved_by": F.coalesce("meta.approved_by", "updated_by"),
        "version": F.coalesce("meta.version", "config_version", F.lit("1.0")),
        "confidence": F.coalesce("meta.confidence_score", F.lit(0.8)),
        "dependencies": F.when(F.col("dependency").isNull(), F.array().cast("array<string>")).otherwise(F.array("dependency")),
        "detection_method": F.when(F.lower("detection_method") == "ast_analysis", "AST").otherwise(F.col("detection_method")),
    })


def invalid_reasons(prefixes: tuple[str, ...] = ALLOWED_PREFIXES) -> Column:
    """Why a filled row is invalid, as an array of words."""
    module = F.concat(F.substring_index("detector_class", ":", 1), F.lit("."))
    allowed = F.lit(False)
    for p in prefixes:
        allowed = allowed | module.startswith(p.rstrip(".") + ".")
    checks = (
        ("rule_id", ~F.col("rule_id").rlike(r"^[A-Z]+_\d{3}$")),
        ("name", ~F.length("name").between(10, 200)),
        ("explanation", F.length("explanation") < 50),
        ("category", ~F.col("category").isin(*CATEGORIES)),
        ("severity", ~F.col("severity").isin(*SEVERITIES)),
        ("method", ~F.col("detection_method").isin(*METHODS)),
        ("class", ~F.col("detector_class").rlike(r"^[\w.]+:[A-Z]\w+$")),
        ("module", ~allowed),
        ("confidence", ~F.col("confidence").between(0.0, 1.0)),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks]))


def validated(rules: DataFrame) -> DataFrame:
    return fill_defaults(parse_json(rules)).withColumn("reasons", invalid_reasons())


def latest_active(rules: DataFrame) -> DataFrame:
    """Newest active version per rule; versions compare as text, then by time."""
    active = rules.filter(F.col("is_active"))
    return latest_per_key(active, ["rule_id"], [F.col("config_version"), F.col("updated_at"), F.col("load_seq")])


def source_rank() -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    return F.element_at(ranks, F.col("source_name"))


def effective(*sources: DataFrame) -> DataFrame:
    """Last writer wins, whole row, in the order built-in < yaml < table."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    return latest_per_key(rows, ["rule_id"], [source_rank(), F.col("load_seq")])


def override_history(rules: DataFrame) -> DataFrame:
    """Sources of each rule in load order, and the effective one."""
    ordered = F.array_sort(F.collect_list(F.struct(source_rank().alias("rank"), "load_seq", "source_name")))
    out = rules.groupBy("rule_id").agg(ordered.alias("h"))
    names = F.transform("h", lambda x: x["source_name"])
    return out.select("rule_id", names.alias("history"), F.element_at(names, -1).alias("effective_source"))


def changed_fields(rules: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Fields that differ from the version loaded before it: severity, enabled, thresholds, message."""
    watched = ["severity", "enabled", "custom_thresholds", "custom_message"]
    ranked = rules.withColumn("_rank", source_rank())
    bucket = F.struct(F.col("_rank"), F.floor(F.col("load_seq") / bucket_rows))
    prev = previous_row(ranked, ["rule_id"], bucket, [F.col("_rank"), F.col("load_seq")], watched, "_before")
    fields = F.array_compact(F.array(*[
        F.when(~F.col(c).eqNullSafe(F.col(f"_before.{c}")), F.lit(c)) for c in watched
    ]))
    return prev.filter(F.col("_before").isNotNull()).withColumn("changes", fields).drop("_before", "_rank")


def override_stats(rules: DataFrame) -> DataFrame:
    # Source names are few (SOURCE_RANK), and so are the different sets of them that meet in the last step.
    per_rule = rules.groupBy("rule_id").agg(F.count("*").alias("n"), F.collect_set("source_name").alias("sources"))
    return per_rule.agg(
        F.count("*").alias("total_rules"), F.count(F.when(F.col("n") > 1, 1)).alias("overridden_rules"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))), ", ").alias("sources_used"))


def upsert(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """New snapshot of the rules table, keyed by rule and version."""
    values = [c for c in table.columns if c not in ("rule_id", "config_version")]
    return merge(table, incoming, ["rule_id", "config_version"], [v for v in values if v not in ("updated_at", "load_seq")])
