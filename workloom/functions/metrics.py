"""Metric, rating and cost expressions over history rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from workloom.functions.formats import fixed, with_unit

GIB = 1024 ** 3
MIB = 1024 ** 2

# Rate per node and hour by node type, in look-up order.
DBU_RATES = (
    ("r5.large", 0.75), ("r5.xlarge", 1.5), ("r5.2xlarge", 3.0), ("r5.4xlarge", 6.0),
    ("r5.8xlarge", 12.0), ("r5.12xlarge", 18.0), ("r5.16xlarge", 24.0), ("r5.24xlarge", 36.0),
    ("i3.xlarge", 1.0), ("i3.2xlarge", 2.0), ("i3.4xlarge", 4.0), ("i3.8xlarge", 8.0),
    ("i3.16xlarge", 16.0),
    ("c5.large", 0.5), ("c5.xlarge", 1.0), ("c5.2xlarge", 2.0), ("c5.4xlarge", 4.0),
    ("c5.9xlarge", 9.0), ("c5.12xlarge", 12.0), ("c5.18xlarge", 18.0),
    ("m5.large", 0.69), ("m5.xlarge", 1.38), ("m5.2xlarge", 2.76), ("m5.4xlarge", 5.52),
    ("m5.8xlarge", 11.04), ("m5.12xlarge", 16.56), ("m5.16xlarge", 22.08), ("m5.24xlarge", 33.12),
)
# Workload multipliers; an unknown workload counts as all_purpose.
WORKLOAD_MULTIPLIERS = {"jobs": 1.0, "all_purpose": 3.0, "sql_warehouse": 2.2}
DBU_USD = 0.10            # price of one unit
DBU_PER_GB = 0.25         # estimate from memory
DBU_DEFAULT = 2.0         # nothing known
TASK_MS_USD = 0.00001     # task-time estimate per millisecond
RUNS_PER_DAY = 24


def is_slow(duration_ms: Column, threshold_s: float = 60) -> Column:
    return (duration_ms / 1000) > threshold_s


def duration_text(duration_ms: Column) -> Column:
    seconds = duration_ms / 1000
    return F.when(seconds < 60, with_unit(seconds, 1, "s")).otherwise(with_unit(seconds / 60, 1, "m"))


def bytes_text(n: Column) -> Column:
    return F.when(n / GIB < 1, with_unit(n / MIB, 1, "MB")).otherwise(with_unit(n / GIB, 2, "GB"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; null when either is null or the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def memory_gb_whole(text: Column, bare_unit: str = "m") -> Column:
    """'8GB', '8g', '8192m', '8388608k' to whole GB; a bare number counts as ``bare_unit``."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^(\d+)", 1)
    unit = F.regexp_extract(low, r"^\d+([gmk])", 1)
    unit = F.when(unit == "", F.lit(bare_unit)).otherwise(unit)
    n = F.when(number == "", F.lit(None)).otherwise(number).cast("bigint")
    return (
        F.when(text.isNull(), F.lit(None).cast("bigint"))
        .when(number == "", F.lit(0).cast("bigint"))
        .when(unit == "g", n)
        .when(unit == "m", F.floor(n / 1024))
        .otherwise(F.floor(n / (1024 * 1024)))
    )


def memory_gb(text: Column) -> Column:
    """'61GB', '8 GB', '1024MB', '2TB' (prefix match) to GB; anything else is null."""
    up = F.upper(text)
    number = F.regexp_extract(up, r"^(\d+\.?\d*)\s*(?:GB|MB|TB)", 1)
    unit = F.regexp_extract(up, r"^\d+\.?\d*\s*(GB|MB|TB)", 1)
    n = F.when(number != "", number).cast("double")
    return F.when(unit == "MB", n / 1024).when(unit == "TB", n * 1024).when(unit == "GB", n)


def performance_rating(duration_ms: Column, shuffle_ratio: Column) -> Column:
    return (
        F.when(shuffle_ratio > 1.0, "CRITICAL")
        .when(duration_ms / 1000 > 300, "CRITICAL")
        .when(duration_ms / 1000 > 60, "WARNING")
        .otherwise("NORMAL")
    )


def network_rating(shuffle_ratio: Column) -> Column:
    return (
        F.when(shuffle_ratio.isNull(), F.lit(None).cast("string"))
        .when(shuffle_ratio > 1.0, "CRITICAL")
        .when(shuffle_ratio > 0.5, "WARNING")
        .when(shuffle_ratio == 0.0, "OPTIMAL")
        .otherwise("NORMAL")
    )


def network_evidence(shuffle_ratio: Column) -> Column:
    return (
        F.when(shuffle_ratio.isNull(), F.lit(None).cast("string"))
        .when(shuffle_ratio > 1.0, with_unit(shuffle_ratio * 100, 1, "% of the scan", "shuffle is "))
        .when(shuffle_ratio > 0.5, "high network traffic relative to the scan")
        .when(shuffle_ratio == 0.0, "no shuffle, probably a broadcast join")
        .otherwise("usual shuffle volume")
    )


def io_rating(read_bytes: Column) -> Column:
    return (
        F.when(read_bytes / GIB > 100, "CRITICAL")
        .when(read_bytes / GIB > 10, "WARNING")
        .otherwise("NORMAL")
    )


def memory_rating(peak_mb: Column, executor_gb: Column) -> Column:
    """Null without a peak; INFO without a cluster; else by share of the executor memory."""
    percent = F.coalesce(F.try_divide(peak_mb * 100.0, executor_gb * 1024.0), F.lit(0.0))
    return (
        F.when(peak_mb.isNull() | (peak_mb == 0), F.lit(None).cast("string"))
        .when(executor_gb.isNull(), "INFO")
        .when(percent > 90, "CRITICAL")
        .when(percent > 70, "WARNING")
        .otherwise("NORMAL")
    )


def rate_key(node_type: Column) -> Column:
    """The last two dot parts of a node type."""
    return F.substring_index(node_type, ".", -2)


def rate_by_node(node_type: Column) -> Column:
    """Exact rate, else the first table entry that contains the cleaned name, else null."""
    key = rate_key(node_type)
    exact = F.create_map(*[F.lit(x) for kv in DBU_RATES for x in kv])
    loose = F.replace(F.replace(F.lower(key), F.lit("standard_"), F.lit("")), F.lit("_"), F.lit("."))
    table = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(rate).alias("rate")) for name, rate in DBU_RATES
    ])
    first = F.filter(table, lambda r: F.contains(r["name"], loose))
    return F.coalesce(
        F.element_at(exact, key), F.when(F.size(first) > 0, first[0]["rate"])
    )


def node_rate(node_type: Column, memory: Column) -> Column:
    return F.coalesce(
        rate_by_node(node_type), memory_gb(memory) * DBU_PER_GB, F.lit(DBU_DEFAULT)
    )


def rate_method(node_type: Column) -> Column:
    return F.when(rate_by_node(node_type).isNotNull(), "accurate").otherwise("estimated")


def workload_factor(workload: Column) -> Column:
    factors = F.create_map(*[F.lit(x) for kv in WORKLOAD_MULTIPLIERS.items() for x in kv])
    return F.coalesce(F.element_at(factors, workload), F.lit(WORKLOAD_MULTIPLIERS["all_purpose"]))


def hourly_cost(rate: Column, workload: Column, workers: Column) -> Column:
    return rate * workload_factor(workload) * (workers + 1) * DBU_USD


def run_cost(hourly: Column, duration_ms: Column) -> Column:
    return hourly * (duration_ms / (1000 * 60 * 60))


def waste_text(actual_ms: Column, baseline_ms: Column) -> Column:
    """A baseline below a millisecond is zero; the factor is then infinite, written as printf does."""
    factor = F.when(baseline_ms == 0, "inf").otherwise(fixed(F.try_divide(actual_ms, baseline_ms), 1))
    return F.when(actual_ms <= baseline_ms, "already at its best").otherwise(
        F.concat(
            F.lit("takes "), factor, F.lit("x longer than optimal ("),
            fixed(actual_ms / 1000, 0), F.lit("s vs "), fixed(baseline_ms / 1000, 0), F.lit("s)"),
        )
    )
