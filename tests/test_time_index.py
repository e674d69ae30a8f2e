"""Utilisation through whole slots against the plain pairs of runs and samples."""

import random

import pytest
from pyspark.sql import functions as F

from workloom.operators import temporal_joins, time_index

ORIGIN = 1_700_000_000
RUNS = "statement_id string, compute_id string, start_time timestamp, total_duration_ms bigint"
SAMPLES = ("cluster_id string, instance_id string, start_time timestamp, end_time timestamp, mem_used_percent double, "
           "mem_swap_percent double, cpu_user_percent double, cpu_system_percent double, cpu_wait_percent double, "
           "network_sent_bytes bigint, network_received_bytes bigint")


def frames(spark, runs, samples):
    epoch = lambda df, *cols: df.withColumns({c: F.timestamp_millis(F.col(c)) for c in cols})
    r = spark.createDataFrame(runs, RUNS.replace("timestamp", "bigint"))
    s = spark.createDataFrame(samples, SAMPLES.replace("timestamp", "bigint"))
    return epoch(r, "start_time"), epoch(s, "start_time", "end_time")


def drawn(lengths, seed):
    rnd = random.Random(seed)
    at = lambda span: 1000 * ORIGIN + rnd.randrange(span)
    runs = [(f"s{i}", rnd.choice(["a", "b", None]), at(40_000_000), rnd.choice([0, 900, 59_000, 61_000, 600_000, 9_000_000, None])) for i in range(120)]
    samples = []
    for i in range(900):
        start = at(50_000_000)
        start -= start % rnd.choice([1, 1000, 60_000])
        num = lambda: rnd.choice([None, float(rnd.randrange(100))])
        samples.append((rnd.choice(["a", "b", None]), rnd.choice(["n1", "n2", "n3", None]), start, start + 1000 * rnd.choice(lengths),
                        num(), num(), num(), num(), num(), rnd.randrange(999), rnd.choice([None, 7])))
    return runs, samples


def rows(df):
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(show(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("lengths", [(60,), (30, 60), (1, 60, 90, 600, 7200)])
def test_equals_the_plain_pairs(spark, lengths):
    history, timeline = frames(spark, *drawn(lengths, len(lengths)))
    want = temporal_joins.utilisation(temporal_joins.samples_in_run(history, timeline))
    got = time_index.utilisation(history, timeline)
    assert rows(got) == rows(want) and got.count() > 10


def test_a_run_joins_few_rows(spark):
    minutes = 5000
    samples = [("a", f"n{k}", 1000 * ORIGIN // 60_000 * 60_000 + 60_000 * m, 1000 * ORIGIN // 60_000 * 60_000 + 60_000 * (m + 1), 1.0, 0.0, 1.0, 1.0, 1.0, 1, 1)
               for m in range(minutes) for k in range(3)]
    history, timeline = frames(spark, [("s", "a", 1000 * ORIGIN + 1500, 60_000 * (minutes - 60))], samples)
    assert time_index.joined(history, timeline).count() < 40
    assert time_index.utilisation(history, timeline).first()["sample_count"] == 3 * (minutes - 61)


def test_slots_cover_each_minute_once(spark):
    rnd = random.Random(3)
    spans = [(a, a + rnd.choice([-2, 0, 1, 2, 63, 64, 1000])) for a in (rnd.randrange(10_000) for _ in range(60))]
    df = spark.createDataFrame(spans, "a bigint, b bigint").withColumn("x", time_index.slots(F.col("a"), F.col("b"), 11))
    for a, b, found in df.collect():
        covered = [m for s in found for m in range(s["slot"] << s["level"], (s["slot"] + 1) << s["level"])]
        assert sorted(covered) == list(range(a, b)) and len(found) <= 2 * 11


def test_no_samples(spark):
    history, timeline = frames(spark, *drawn((60,), 1))
    assert time_index.utilisation(history, timeline.limit(0)).count() == 0
    assert time_index.utilisation(history.limit(0), timeline).count() == 0
