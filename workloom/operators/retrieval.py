"""Guideline retrieval: sections, priorities, keyword scores, budgets, vectors, compression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.operators.budget import take_until_overflow, take_what_fits
from workloom.operators.ranking import join_same, top_k
from workloom.session import written

# Priority keywords, and those that score 10 and 20; anything else scores 40.
PRIORITY_WORDS = ("CRITICAL", "HIGH PRIORITY", "IMPORTANT", "MUST", "REQUIRED", "MANDATORY", "SEVERE", "URGENT", "WARNING")
TOP_WORDS = ("CRITICAL", "MUST", "REQUIRED", "MANDATORY")
HIGH_WORDS = ("HIGH PRIORITY", "IMPORTANT", "URGENT", "SEVERE", "WARNING")

# Violation classes with the pattern parts that decide them, first class wins.
VIOLATION_CLASSES = (
    ("security", ("security", "privacy", "pii", "gdpr", "data_exposure", "access", "auth", "permission")),
    ("performance", ("slow", "performance", "latency", "timeout", "duration")),
    ("resource", ("memory", "oom", "resource", "executor", "cluster", "broadcast_join")),
    ("efficiency", ("shuffle", "scan", "bytes", "network", "io", "cartesian", "select_star", "partition")),
)
# Keywords added per class, and metric names kept per class.
CLASS_WORDS = {
    "security": ("data", "privacy", "pii", "gdpr", "access", "consent", "breach"),
    "performance": ("slow", "duration", "latency", "optimize", "speed", "time"),
    "resource": ("memory", "cpu", "executor", "cluster", "resource", "oom"),
    "efficiency": ("shuffle", "scan", "bytes", "network", "io", "data"),
}
CLASS_METRICS = {
    "performance": ("duration", "bytes_scanned", "shuffle", "scan_rate"),
    "resource": ("peak_memory", "executor", "memory_util", "cluster"),
    "efficiency": ("shuffle_ratio", "bytes_per_second", "network"),
    "security": ("data_scanned", "rows", "tables"),
}
FENCE = "```"
CODE_BLOCK = rf"(?si){FENCE}(?:sql)?\s*\n(.*?)\n{FENCE}"
TABLE_REF = r"(?i)\b(?:FROM|JOIN|INTO|TABLE)\s+([a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)*)"
# Node types a cluster recommendation may name.
KNOWN_NODES = ("i3.xlarge", "i3.2xlarge", "i3.4xlarge", "i3.8xlarge")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; inside a lambda Spark computes it at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def truncated(text: Column, max_tokens: int) -> Column:
    return F.when(F.length(text) <= max_tokens * 4, text).otherwise(F.concat(
        F.substring(text, 1, max_tokens * 4), F.lit(f"\n\n[Content truncated at {max_tokens} tokens]")))


def sections(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """One row per level-2 section, cut inside the row: no shuffle, whatever the corpus."""
    rest = [c for c in docs.columns if c != text]
    pieces = docs.select(*rest, F.split(text, r"(?md)^(?=##\s+\S)").alias("pieces"))
    starts = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("line"), F.array().cast("array<int>").alias("starts")),
        lambda acc, p: F.struct(
            (acc["line"] + F.size(F.split(p, "\n")) - 1).alias("line"),
            F.concat(acc["starts"], F.array(acc["line"])).alias("starts")),
        lambda acc: acc["starts"],
    )
    rows = pieces.withColumn("starts", starts).withColumn("last", F.size("pieces") - 1).select(
        *rest, "starts", "last", F.posexplode_outer("pieces").alias("pos", "piece"))
    rows = rows.filter(F.col("piece").rlike(r"^##\s+\S")).withColumn("lines", F.split("piece", "\n"))
    is_last = F.col("pos") == F.col("last")
    n_lines = F.when(is_last, F.size("lines")).otherwise(F.size("lines") - 1)
    start = F.get("starts", F.col("pos"))
    body = F.filter(F.slice("lines", F.lit(2), n_lines - 1), lambda x: ~x.rlike(r"^#\s+.+$"))
    return rows.select(
        *rest, F.col("pos").alias("section_no"),
        F.trim(F.regexp_replace(F.col("lines")[0], r"^##\s+", "")).alias("heading"),
        F.array_join(body, "\n").alias("content"),
        start.alias("line_start"), (start + n_lines - 1).alias("line_end"),
    )


def priority_words(heading: Column, content: Column) -> Column:
    return once(F.upper(heading), lambda up_h: once(F.upper(content), lambda up_c: F.array_compact(F.array(*[
        F.when(F.contains(up_h, F.lit(w)) | F.contains(up_c, F.lit(w)), F.lit(w)) for w in sorted(PRIORITY_WORDS)]))))


def priority_score(words: Column) -> Column:
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
    return F.when(has(TOP_WORDS), 10).when(has(HIGH_WORDS), 20).otherwise(40)


def described(secs: DataFrame) -> DataFrame:
    """Add priority words and score, code blocks, tables in the blocks, token estimate."""
    blocks = F.filter(
        F.transform(F.regexp_extract_all("content", F.lit(CODE_BLOCK), F.lit(1)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")),
        lambda b: b != "")
    df = secs.withColumns({"words": priority_words(F.col("heading"), F.col("content")), "code_blocks": blocks})
    tables = F.array_sort(F.array_distinct(F.flatten(F.transform("code_blocks", lambda b: F.transform(
        F.regexp_extract_all(b, F.lit(TABLE_REF), F.lit(1)), lambda t: F.lower(t))))))
    return df.withColumns({
        "priority": priority_score(F.col("words")), "affected_tables": tables, "tokens": tokens(F.col("content"))})


def relevance(described_sections: DataFrame, query_tables: list[str]) -> DataFrame:
    """Priority, minus 15 for a shared table, minus 5 for a code example; lower is better."""
    wanted = F.array(*[F.lit(t.lower()) for t in query_tables])
    overlap = F.arrays_overlap("affected_tables", wanted)
    return described_sections.withColumns({
        "table_overlap": overlap,
        "score": F.col("priority") - F.when(overlap, 15).otherwise(0) - F.when(F.size("code_blocks") > 0, 5).otherwise(0),
    })


def select_sections(scored: DataFrame, groups: list[str], row_id: list[str], max_tokens: int = 2000) -> DataFrame:
    """Critical sections that fit first, then the others in order until one does not fit."""
    order = F.struct("score", *row_id)
    keys = list(dict.fromkeys([*groups, *row_id]))
    # Several passes read the scores; they are written once, without the texts.
    scored = written(scored.select(*keys, "score", "priority", "tokens"))
    critical = take_what_fits(
        scored.filter(F.col("priority") <= 10), groups, order, "tokens", row_id, max_tokens
    ).select(*groups, *row_id, "tokens")
    used = critical.groupBy(*groups).agg(F.sum("tokens").alias("used_tokens"))
    rest = join_same(scored, critical.select(*keys), keys, "left_anti")
    second = take_until_overflow(rest, groups, order, "tokens", row_id, max_tokens, used)
    return critical.select(*keys, "tokens").withColumn("pass", F.lit(1)).unionByName(
        second.select(*keys, "tokens").withColumn("pass", F.lit(2)))


def guideline_stats(described_sections: DataFrame, doc_id: str) -> DataFrame:
    p = F.col("priority")
    counts = described_sections.agg(
        F.count("*").alias("total_sections"), F.count(F.when(p <= 10, 1)).alias("critical_sections"),
        F.count(F.when((p > 10) & (p <= 20), 1)).alias("high_sections"),
        F.count(F.when((p > 20) & (p <= 30), 1)).alias("medium_sections"),
        F.sum(F.size("code_blocks")).alias("total_code_blocks"), F.sum("tokens").alias("total_tokens"),
        F.count_distinct(doc_id).alias("files_loaded"))
    tables = described_sections.select(F.explode("affected_tables").alias("t")).agg(F.count_distinct("t").alias("unique_tables"))
    return counts.withColumn("one", F.lit(1)).join(tables.withColumn("one", F.lit(1)), "one").drop("one")


def top_headings(described_sections: DataFrame, row_id: list[str], limit: int = 10) -> DataFrame:
    band = F.when(F.col("priority") <= 10, "CRITICAL").when(F.col("priority") <= 20, "HIGH").otherwise("MEDIUM")
    return described_sections.orderBy("priority", *row_id).limit(limit).select(*row_id, "heading", band.alias("band"))


# --- keyword filtering -------------------------------------------------------------------------

def violation_class(pattern: Column) -> Column:
    low, out = F.lower(pattern), None
    for name, parts in VIOLATION_CLASSES:
        hit = low.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def class_lookup(table: dict[str, tuple[str, ...]], cls: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), cls), F.array().cast("array<string>"))


def keywords(pattern: Column, cls: Column) -> Column:
    own = F.filter(F.split(F.replace(F.lower(pattern), F.lit("_"), F.lit(" ")), " "), lambda w: w != "")
    return F.array_sort(F.array_union(own, class_lookup(CLASS_WORDS, cls)))


def paragraphs(text: Column) -> Column:
    """Blank-line blocks with trimmed lines."""
    lines = F.regexp_replace(text, r"(?md)^[ \t\r]+|[ \t\r]+$", "")
    return F.filter(F.transform(F.split(lines, r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), lambda p: p != "")


def header_blocks(text: Column) -> Column:
    """Blocks cut before each Markdown header."""
    return F.filter(
        F.transform(F.split(text, r"\n(?=#+\s)"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: b != "")


def occurrences(text: Column, word: Column) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word))


def section_score(section: Column, words: Column, cls: Column) -> Column:
    def score(low: Column) -> Column:
        total = F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc + occurrences(low, w))
        return total * F.when(F.contains(low, cls), 2).otherwise(1)

    return once(F.lower(section), score)


def _ordered_desc(items: Column) -> Column:
    """Structs (score, text) in descending order."""
    return F.reverse(F.array_sort(items))


def filtered_context(text: Column, words: Column, cls: Column, budget: int = 250) -> Column:
    """Best paragraphs under the budget, else the first 500 characters. Works inside one row."""
    scored = F.filter(
        F.transform(paragraphs(text), lambda p: F.struct(section_score(p, words, cls).alias("score"), p.alias("text"))),
        lambda s: s["score"] > 0)
    start = F.struct(
        F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("taken"))

    def step(acc: Column, s: Column) -> Column:
        cost = tokens(s["text"])
        fits = ~acc["full"] & (acc["used"] + cost <= budget)
        return F.struct(
            F.when(fits, acc["used"] + cost).otherwise(acc["used"]).alias("used"),
            (acc["full"] | ~fits).alias("full"),
            F.when(fits, F.concat(acc["taken"], F.array(s["text"]))).otherwise(acc["taken"]).alias("taken"))

    taken = F.aggregate(_ordered_desc(scored), start, step, lambda acc: acc["taken"])
    return F.when(F.size(taken) > 0, F.array_join(taken, "\n\n")).otherwise(F.substring(text, 1, 500))


def keyword_top(text: Column, words: Column, k: int = 3) -> Column:
    """The k blocks with most keywords present, else the first 800 characters."""
    scored = F.transform(header_blocks(text), lambda b: F.struct(
        once(F.lower(b), lambda low: F.size(F.filter(words, lambda w: F.contains(low, w)))).alias("score"), b.alias("text")))
    best = F.transform(F.slice(_ordered_desc(scored), 1, k), lambda s: s["text"])
    return F.when(F.size(best) > 0, F.array_join(best, "\n\n")).otherwise(F.substring(text, 1, 800))


def metric_lines(text: Column, cls: Column) -> Column:
    """Lines that name a metric of the class, and all header-like lines."""
    names = class_lookup(CLASS_METRICS, cls)
    kept = F.filter(F.split(text, "\n"), lambda line: (
        F.exists(names, lambda n: F.contains(F.lower(line), n))
        | F.contains(line, F.lit("**")) | F.contains(line, F.lit(":"))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(text)


def compressed(df: DataFrame) -> DataFrame:
    """Compress each row's context, guidelines and metrics; needs no shuffle.

    Rows with equal inputs have equal results and one ``cache_key``, the hash of the joined inputs.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.sha2(F.concat_ws("|", F.col("pattern"), empty("context"), empty("guidelines"), empty("metrics")), 256)
    once = df.withColumn("cache_key", key).withColumn("cls", violation_class(F.col("pattern")))
    once = once.withColumn("words", keywords(F.col("pattern"), F.col("cls")))
    out = once.withColumns({
        "small_context": filtered_context(F.col("context"), F.col("words"), F.col("cls")),
        "small_guidelines": keyword_top(F.col("guidelines"), F.col("words")),
        "small_metrics": metric_lines(F.col("metrics"), F.col("cls")),
    })
    size = lambda *cols: sum((tokens(empty(c)) for c in cols[1:]), tokens(empty(cols[0])))
    out = out.withColumns({
        "original_tokens": size("context", "guidelines", "metrics"),
        "compressed_tokens": size("small_context", "small_guidelines", "small_metrics"),
    })
    return out.withColumn("ratio", F.when(
        F.col("original_tokens") > 0, F.col("compressed_tokens") / F.col("original_tokens")).otherwise(1.0))


def compression_sizes(df: DataFrame) -> DataFrame:
    """Tokens before and after, once per distinct input; only sizes are shuffled, not texts."""
    sizes = ("original_tokens", "compressed_tokens", "ratio")
    return compressed(df).groupBy("cache_key").agg(*[F.max(c).alias(c) for c in sizes])


# --- recommendations ---------------------------------------------------------------------------

def addressed(recommendations: DataFrame) -> DataFrame:
    """(statement_id, rec_no, rule_key) of each addressed violation."""
    return recommendations.filter(F.col("violations_csv") != "").select(
        "statement_id", "rec_no", F.explode(F.split("violations_csv", ",")).alias("rule_key"))


def uncovered(violations: DataFrame, recommendations: DataFrame) -> DataFrame:
    return violations.join(addressed(recommendations), ["statement_id", "rule_key"], "left_anti")


def covered_by(violations: DataFrame, recommendations: DataFrame) -> DataFrame:
    numbers = addressed(recommendations).groupBy("statement_id", "rule_key").agg(
        F.array_sort(F.collect_set("rec_no")).alias("nos"))
    return violations.join(numbers, ["statement_id", "rule_key"]).withColumn(
        "covered_by", F.array_join(F.transform("nos", lambda n: F.concat(F.lit("#"), n.cast("string"))), ", ")).drop("nos")


def checked_recommendations(recs: DataFrame) -> DataFrame:
    """Every recommendation with the reason for rejecting it, null when it is fine."""
    low = F.lower("description")
    nothing_wrong = F.contains(low, F.lit("no")) & (F.contains(low, F.lit("issue")) | F.contains(low, F.lit("optimized")))
    names_node = F.col("description").rlike("|".join(n.replace(".", r"\.") for n in KNOWN_NODES))
    return recs.withColumn(
        "reason",
        F.when(F.col("rec_type").isin("code_fix", "query_rewrite") & (F.col("violations_csv") == "") & ~nothing_wrong, "names no violation")
        .when(F.length("description") < 20, "description too short")
        .when(F.length("implementation") < 30, "implementation too short")
        .when(F.coalesce("expected_improvement", F.lit("")) == "", "no expected improvement")
        .when((F.col("rec_type") == "cluster_config") & ~names_node, "unknown node type"),
    )
