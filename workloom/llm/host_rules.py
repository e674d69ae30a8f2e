"""Quality rules per document and per host, with DataFrame functions only.

Each document gets its base measures and a few soft rules. Failures of the soft rules and of the
base rule are counted per host; a host's rate is shrunk towards the mean of all hosts with a beta
prior whose strength comes from the hosts themselves (method of moments), so a host of few
documents is not judged by chance. A host is rejected if its shrunk rate of some rule reaches
``HOST_LIMIT``. A document goes if it fails the base rule, or if its host is rejected and it fails
some soft rule itself: a clean document of a bad host stays.

Null and empty texts have no words and fail the base rule. Documents without a host form a host
of their own (null). Repeated rows are judged alike and count as often as they occur.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.llm.shared import kept

MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
HOST_LIMIT = 0.5
BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Soft rules: share of symbols per word, of repeated lines, and the mean length of words.
RULES = {
    "fails_base": "base_failed",
    "fails_symbols": "10 * n_symbols > n_words",
    "fails_lines": "n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines",
    "fails_length": "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)",
}


def window_hashes(hashes: Column) -> Column:
    """A hash of each run of WINDOW word hashes; null where there are fewer than two runs."""
    n = F.size(hashes) - (WINDOW - 1)
    return F.when(n >= 2, F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.xxhash64(*[F.get(hashes, i + (k - 1)) for k in range(WINDOW)]),
    ))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, and the measures of every document."""
    lines = F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_replace(x, BLANK, "") != "")
    first = docs.select(
        F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("source").alias("host"),
        F.filter(F.split(F.coalesce("text", F.lit("")), BLANK), lambda w: w != "").alias("words"),
        (F.size(F.split(F.coalesce("text", F.lit("")), SYMBOL)) - 1).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    second = first.select(
        "doc_id", "th", "host", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    third = second.select("*", window_hashes(F.col("hashes")).alias("windows")).drop("hashes")
    # Only a text with a repeated window is sorted; its windows of one hash stand side by side.
    fourth = third.select("*", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).alias("order")).drop("windows")
    fifth = fourth.select("*", F.array_sort(F.transform(
        F.filter(
            F.transform("order", lambda x, k: F.struct(
                x.i.alias("i"),
                ((k > 0) & (x.h == F.get(F.col("order"), F.greatest(k - 1, F.lit(0))).h)
                 | F.coalesce(x.h == F.get(F.col("order"), k + 1).h, F.lit(False))).alias("twice"))),
            lambda x: x.twice),
        lambda x: x.i)).alias("at")).drop("order")
    covered = F.aggregate(
        F.transform("at", lambda i, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1) - i, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    sixth = fifth.select("*", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words")).drop("at")
    return sixth.withColumn("base_failed", F.expr(
        f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words"))


def shrunk_rates(measures: DataFrame) -> DataFrame:
    """Per host: documents, and the shrunk failure rate of every rule."""
    hosts = measures.groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(F.expr(rule).cast("bigint")).alias(name) for name, rule in RULES.items()])
    # One row of moments over hosts: the rates' mean, and their variance beyond what chance gives.
    moments = hosts.agg(
        F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(1 / F.col("n")).alias("inverse"),
        *[F.sum(name).alias(name) for name in RULES],
        *[F.var_samp(F.col(name) / F.col("n")).alias(f"var_{name}") for name in RULES],
    ).first()
    out = hosts
    for name in RULES:
        alpha, beta = beta_prior(moments, name)
        out = out.withColumn(f"rate_{name}", (F.col(name) + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta)))
    return out


def beta_prior(moments, name: str) -> tuple[float, float]:
    """Alpha and beta by the method of moments; strength 1 to 1000, 1 where hosts tell nothing."""
    if not moments["n"]:
        return 0.5, 0.5
    mean = moments[name] / moments["n"]
    spread = mean * (1 - mean)
    noise = spread * moments["inverse"] / moments["hosts"]
    between = (moments[f"var_{name}"] or 0.0) - noise
    strength = 1000.0 if between <= spread / 1001 else spread / between - 1
    strength = min(max(strength, 1.0), 1000.0)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    return mean * strength, (1 - mean) * strength


def verdicts(docs: DataFrame) -> DataFrame:
    """The measures of every document with its host's rates and ``kept``."""
    measures = kept(measured(docs), "measures")
    rates = shrunk_rates(measures)
    bad = reduce(lambda a, b: a | b, (F.col(f"rate_{name}") >= HOST_LIMIT for name in RULES))
    hosts = rates.select(F.col("host").alias("_host"), bad.alias("host_rejected"))
    soft = reduce(lambda a, b: a | b, (F.expr(rule) for name, rule in RULES.items() if name != "fails_base"))
    return (
        measures.join(hosts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
        .withColumn("kept", ~F.col("base_failed") & ~(F.col("host_rejected") & soft))
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents whose verdict is ``kept``, with all their columns."""
    bad = verdicts(docs).filter(~F.col("kept")).select(
        F.col("doc_id").alias("__bad_id"), F.col("th").alias("__bad_th"), F.col("host").alias("__bad_host")).distinct()
    on = (
        (F.xxhash64("text") == F.col("__bad_th")) & F.col("doc_id").eqNullSafe(F.col("__bad_id"))
        & F.col("source").eqNullSafe(F.col("__bad_host"))
    )
    return docs.join(bad, on, "left_anti")
