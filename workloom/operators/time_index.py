"""Utilisation of runs through a dyadic index over the minutes of the node samples.

Samples are summed up per (cluster, level, slot), where a slot of level l is 2**l minutes. A run of n
minutes is cut into about 2 log2(n) whole slots, so it joins that many rows instead of all its
samples; only samples that start in its first or last minutes are compared one by one.

Samples are divided by length: class j ends within 2**j minutes of the minute it starts in. Those of
class j that start in the minutes from a + 1 to b - 2**j lie inside a run from minute a to minute b for
certain; the others near both ends are compared with the run's exact times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CPU = "cpu_user_percent + cpu_system_percent"
#: Figures that merge: per name its aggregate and its expression over one sample.
FIGURES = {
    "mem_max": (F.max, "mem_used_percent"), "mem_sum": (F.sum, "mem_used_percent"),
    "mem_n": (F.sum, "CAST(mem_used_percent IS NOT NULL AS BIGINT)"),
    "swap_max": (F.max, "mem_swap_percent"),
    "cpu_max": (F.max, CPU), "cpu_sum": (F.sum, CPU), "cpu_n": (F.sum, f"CAST({CPU} IS NOT NULL AS BIGINT)"),
    "wait_sum": (F.sum, "cpu_wait_percent"), "wait_n": (F.sum, "CAST(cpu_wait_percent IS NOT NULL AS BIGINT)"),
    "sent": (F.sum, "network_sent_bytes"), "received": (F.sum, "network_received_bytes"), "samples": (F.sum, "1L"),
}


def _merged(df: DataFrame, *keys: str) -> DataFrame:
    """Sum up rows of figures; the instances of a cluster are few."""
    return df.groupBy(*keys).agg(
        *[f(name).alias(name) for name, (f, _) in FIGURES.items()],
        F.array_distinct(F.flatten(F.collect_set("instances"))).alias("instances"))


def _minute(t: Column) -> Column:
    return F.floor(F.unix_seconds(t) / 60)


def figures(timeline: DataFrame) -> DataFrame:
    """One row per sample: cluster, times, minute, length class, and its figures."""
    samples = timeline.withColumns({c: F.col(c).cast("timestamp") for c in ("start_time", "end_time")})
    minutes = F.greatest(F.lit(1.0), F.ceil(F.unix_micros("end_time") / 60e6) - _minute(F.col("start_time")))
    return samples.filter("cluster_id IS NOT NULL AND start_time IS NOT NULL AND end_time >= start_time").select(
        "cluster_id", "start_time", "end_time", _minute(F.col("start_time")).alias("minute"),
        F.ceil(F.log2(minutes)).cast("int").alias("length"),
        *[F.expr(x).alias(name) for name, (_, x) in FIGURES.items()],
        F.when(F.col("instance_id").isNull(), F.array().cast("array<string>")).otherwise(
            F.array(F.col("instance_id").cast("string"))).alias("instances"))


def slots(first: Column, end: Column, levels: int) -> Column:
    """The (level, slot) structs of the largest slots that make up the minutes from first to end - 1."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        a, b = F.ceil(first / size), F.floor(end / size)
        one = lambda take, slot: F.when((a < b) & (take % 2 != 0), F.struct(
            level.cast("int").alias("level"), slot.cast("bigint").alias("slot")))
        return F.array_compact(F.array(one(a, a), one(b, b - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def slot_figures(samples: DataFrame, levels: int) -> DataFrame:
    """The index: figures per (cluster, length, level, slot)."""
    per_minute = _merged(samples, "cluster_id", "length", "minute")
    every = F.sequence(F.lit(0), F.lit(levels))
    return _merged(per_minute.withColumn("level", F.explode(every)).withColumn(
        "slot", F.expr("shiftright(minute, level)")), "cluster_id", "length", "level", "slot")


def joined(history: DataFrame, timeline: DataFrame) -> DataFrame:
    """Figures per (statement, whole slot) and per (statement, sample near an end of its run)."""
    start = F.date_trunc("second", F.col("start_time").cast("timestamp"))
    end = F.date_trunc("second", F.timestamp_add("MILLISECOND", F.col("total_duration_ms"), F.col("start_time").cast("timestamp")))
    runs = history.filter(
        F.col("compute_id").isNotNull() & F.col("start_time").isNotNull() & (F.col("total_duration_ms") > 0),
    ).select("statement_id", F.col("compute_id").alias("cluster_id"), start.alias("run_start"), end.alias("run_end")).withColumns({
        "a": _minute(F.col("run_start")), "b": _minute(F.col("run_end"))})
    samples = figures(timeline)
    # Two small facts: how long the longest run is, and which lengths of samples there are.
    longest = runs.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 0
    lengths = sorted(r["length"] for r in samples.select("length").distinct().collect())
    levels = max(1, int(longest)).bit_length()
    each = runs.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>")))
    last = F.col("b") - F.pow(F.lit(2.0), F.col("length")).cast("bigint")  # the last minute that is inside for certain
    whole = each.withColumn("x", F.explode(slots(F.col("a") + 1, last + 1, levels))).select(
        "statement_id", "cluster_id", "length", "x.level", "x.slot")
    names = [*FIGURES, "instances"]
    inside = whole.join(slot_figures(samples, levels), ["cluster_id", "length", "level", "slot"]).select("statement_id", *names)
    ends = F.array_distinct(F.concat(F.array("a"), F.sequence(F.greatest(F.col("a"), last + 1), F.col("b"))))
    near = each.withColumn("minute", F.explode(ends)).join(samples, ["cluster_id", "length", "minute"]).filter(
        (F.col("start_time") >= F.col("run_start")) & (F.col("end_time") <= F.col("run_end"))).select("statement_id", *names)
    return inside.unionByName(near)


def utilisation(history: DataFrame, timeline: DataFrame) -> DataFrame:
    """Memory, CPU, wait and network figures per statement with at least one sample in its run."""
    merged = _merged(joined(history, timeline), "statement_id")
    mean = lambda what: F.try_divide(F.col(f"{what}_sum"), F.col(f"{what}_n"))
    return merged.select(
        "statement_id", F.col("mem_max").alias("peak_memory_percent"), mean("mem").alias("avg_memory_percent"),
        (F.coalesce("swap_max", F.lit(0.0)) > 0).alias("memory_swap_detected"),
        F.col("cpu_max").alias("peak_cpu_percent"), mean("cpu").alias("avg_cpu_percent"),
        mean("wait").alias("avg_io_wait_percent"),
        F.col("sent").alias("total_network_sent"), F.col("received").alias("total_network_received"),
        F.size("instances").cast("bigint").alias("node_count"), F.col("samples").alias("sample_count"))
