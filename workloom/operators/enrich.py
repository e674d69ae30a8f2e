"""The enriched statement table: history, cluster, node specs, utilisation, ratings, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloom.functions import metrics as m
from workloom.operators import temporal_joins as tj
from workloom.sources.workspace import task_cost


def with_cluster(history: DataFrame, changes: DataFrame, node_types: DataFrame) -> DataFrame:
    return tj.derive_cluster(tj.add_node_specs(tj.cluster_as_of(history, changes), node_types))


def with_ratios(df: DataFrame) -> DataFrame:
    """Shuffle, spill and selectivity ratios; the produced rows are the scanned rows."""
    return df.withColumns({
        "shuffle_ratio": m.ratio(F.col("shuffle_read_bytes"), F.col("read_bytes")),
        "spill_ratio": m.ratio(F.col("spilled_local_bytes"), F.col("read_bytes")),
        "selectivity_ratio": m.ratio(F.col("produced_rows"), F.col("read_rows")),
        "has_spill": F.coalesce("spilled_local_bytes", F.lit(0)) > 0,
    })


def with_ratings(df: DataFrame) -> DataFrame:
    """Needs ``with_ratios``."""
    return df.withColumns({
        "performance": m.performance_rating(F.col("execution_duration_ms"), F.col("shuffle_ratio")),
        "network": m.network_rating(F.col("shuffle_ratio")),
        "io": m.io_rating(F.col("read_bytes")),
    })


def with_cost(df: DataFrame, workload: str = "all_purpose", runs_per_day: int = m.RUNS_PER_DAY) -> DataFrame:
    """Rate, hourly, per-run and daily cost; null without a cluster."""
    rate = m.node_rate(F.col("node_type"), F.col("executor_memory"))
    priced = df.withColumns({
        "dbu_rate": F.when(F.col("node_type").isNotNull(), rate),
        "rate_method": F.when(F.col("node_type").isNotNull(), m.rate_method(F.col("node_type"))),
    })
    priced = priced.withColumn(
        "hourly_cost", m.hourly_cost(F.col("dbu_rate"), F.lit(workload), F.col("executor_count"))
    ).withColumn("run_cost", m.run_cost(F.col("hourly_cost"), F.col("execution_duration_ms")))
    return priced.withColumn("daily_cost", F.col("run_cost") * runs_per_day)


def with_waste(priced: DataFrame, baseline: str = "baseline_ms", runs_per_day: int = m.RUNS_PER_DAY) -> DataFrame:
    """Daily cost beyond the baseline duration; zero when the run is not slower."""
    actual = F.col("execution_duration_ms")
    return priced.withColumns({
        "daily_waste": F.when(actual <= F.col(baseline), F.lit(0.0)).otherwise(
            F.col("daily_cost") - m.run_cost(F.col("hourly_cost"), F.col(baseline)) * runs_per_day
        ),
        "waste_note": m.waste_text(actual, F.col(baseline)),
    })


def shape_baseline(df: DataFrame, key: str) -> DataFrame:
    """The fastest run per statement shape, as a small table to join back."""
    return df.groupBy(key).agg(F.min("execution_duration_ms").alias("baseline_ms"))


def normalise_cluster_input(rows: DataFrame, node_types: DataFrame) -> DataFrame:
    """Accept either spelling of node type and worker count, fill memory from the node types,
    and say why a row cannot be used."""
    specs = node_types.select(
        F.col("node_type").alias("spec_node"),
        F.concat(F.floor(F.col("memory_mb") / 1024).cast("string"), F.lit("GB")).alias("spec_memory"),
    )
    driver = specs.select(F.col("spec_node").alias("driver_spec"), F.col("spec_memory").alias("driver_spec_memory"))

    def filled(name: str):
        return F.when(~F.col(name).isin("", "0"), F.col(name))

    joined = rows.withColumns({
        "node": F.coalesce(filled("worker_node_type"), filled("node_type")),
        "workers": F.coalesce(
            F.when(F.col("executor_count") != 0, F.col("executor_count")),
            F.when(F.col("worker_count") != 0, F.col("worker_count")),
        ),
    })
    joined = joined.join(specs, joined["node"] == specs["spec_node"], "left").join(
        driver, joined["driver_node_type"] == driver["driver_spec"], "left"
    ).withColumn("memory", F.coalesce(filled("executor_memory"), "spec_memory"))
    return joined.select(
        "config_id", "node", "workers", "memory",
        F.coalesce(filled("driver_memory"), "driver_spec_memory").alias("driver_memory"),
        F.when(F.col("node").isNull(), "missing node type")
        .when(F.col("workers").isNull(), "missing worker count")
        .when(F.col("memory").isNull(), "memory not resolved").alias("problem"),
    )


def enriched(history: DataFrame, changes: DataFrame, node_types: DataFrame, timeline: DataFrame) -> DataFrame:
    """Everything the report reads, one row per statement."""
    base = with_cost(with_ratings(with_ratios(with_cluster(history, changes, node_types))))
    usage = tj.utilisation(tj.samples_in_run(history, timeline))
    return base.join(usage, "statement_id", "left").withColumn(
        "task_cost", task_cost(F.col("total_task_duration_ms"))
    )
