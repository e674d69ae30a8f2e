"""As-of and interval joins against plain Python, with overlapping and deleted versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from workloom.operators import temporal_joins as tj

BASE = dt.datetime(2024, 1, 1)
CHANGES = "cluster_id string, cluster_name string, worker_node_type string, driver_node_type string, worker_count int, min_autoscale_workers int, max_autoscale_workers int, spot_availability string, change_time timestamp_ntz, delete_time timestamp_ntz"


def test_as_of_join(spark):
    rnd = random.Random(5)
    versions = []
    for i in range(300):
        start = BASE + dt.timedelta(minutes=rnd.randrange(0, 8 * 1440, 7))
        end = start + dt.timedelta(hours=rnd.randrange(-1, 60)) if rnd.random() < 0.5 else None
        versions.append((f"c{min(rnd.randrange(5), 2)}", "n", f"type{i:03d}", None, i, None, None, None, start, end))
    runs = [(str(i), rnd.choice(["c0", "c0", "c1", "c2", "c9", None]),
             BASE + dt.timedelta(seconds=rnd.randrange(-86400, 10 * 86400), microseconds=rnd.randrange(10 ** 6))) for i in range(1500)]
    h = spark.createDataFrame(runs, "statement_id string, compute_id string, start_time timestamp_ntz")
    got = {r.statement_id: r.worker_node_type for r in tj.cluster_as_of(h, spark.createDataFrame(versions, CHANGES)).collect()}
    want = {}
    for sid, cluster, at in runs:
        at = at.replace(microsecond=0)
        alive = [(v[8], v[2]) for v in versions if v[0] == cluster and v[8] <= at and (v[9] is None or v[9] > at)]
        want[sid] = max(alive)[1] if alive else None
    assert got == want
    assert sum(v is not None for v in want.values()) > 500


def test_samples_in_run(spark):
    rnd = random.Random(6)
    runs = [(str(i), rnd.choice(["c0", "c1"]), BASE + dt.timedelta(seconds=rnd.randrange(7200)), rnd.choice([None, 0, 500, 90_000, 700_000])) for i in range(200)]
    samples = [(rnd.choice(["c0", "c1"]), f"i{rnd.randrange(3)}", BASE + dt.timedelta(seconds=s), BASE + dt.timedelta(seconds=s + rnd.choice([10, 60, 90]))) for s in (rnd.randrange(9000) for _ in range(500))]
    h = spark.createDataFrame(runs, "statement_id string, compute_id string, start_time timestamp_ntz, total_duration_ms bigint")
    t = spark.createDataFrame(samples, "cluster_id string, instance_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    got = sorted((r.statement_id, r.instance_id, r.s) for r in tj.samples_in_run(h, t).select("statement_id", "instance_id", F.unix_seconds("start_time").alias("s")).collect())
    epoch = dt.datetime(1970, 1, 1)
    want = sorted((sid, i, int((s - epoch).total_seconds())) for sid, c, at, ms in runs if ms for k, i, s, e in samples
                  if k == c and s >= at and e <= (at + dt.timedelta(milliseconds=ms)).replace(microsecond=0))
    assert got == want and want
