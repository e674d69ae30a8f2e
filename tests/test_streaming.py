"""Limiters against a plain simulation; streams over several micro-batches against their twins."""

import datetime as dt
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workloom.plans import load_all
from workloom.streaming import admission, jobs

load_all()
BASE = dt.datetime(2024, 1, 1)


def events(spark, n=4000, seed=2):
    rnd = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += 4000 if rnd.random() < 0.003 else rnd.choice([0, 1, 2, 5, 5, 30, 200 if rnd.random() < 0.05 else 1])
        rows.append((i, BASE + dt.timedelta(seconds=at), "hot" if rnd.random() < 0.6 else f"u{rnd.randrange(4)}", 0.01))
    return rows, spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user string, cost double")


def simulate(rows, per_minute, hourly):
    kept, out = {}, {}
    for i, ts, user, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        mine = kept.setdefault(user, [])
        recent = [t for t in mine if t > ts - dt.timedelta(seconds=60)]
        spent = sum(0.01 for t in mine if t > ts - dt.timedelta(hours=1))
        if len(recent) >= per_minute:
            out[i] = "requests"
        elif spent + 0.01 > hourly:
            out[i] = "cost"
        else:
            out[i] = "admitted"
            mine.append(ts)
    return out


def test_admission_batch(spark):
    rows, df = events(spark)
    got = {r.event_id: r.decision for r in admission.admit(df, "user", admission.Limits(per_minute=5, cost_per_hour=1.0)).collect()}
    want = simulate(rows, 5, 1.0)
    assert got == want
    assert {"admitted", "requests", "cost"} == set(want.values())


def test_minute_cap(spark):
    rows, df = events(spark)
    got = {r.event_id: r.decision for r in admission.cap_per_minute(df, "user", 4).collect()}
    state, want = {}, {}
    for i, ts, user, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        start, count = state.get(user, (None, 0))
        if start is None or (ts - start).total_seconds() >= 60:
            start, count = ts, 0
        want[i] = "dropped" if count >= 4 else "admitted"
        state[user] = (start, count + (count < 4))
    assert got == want and "dropped" in want.values()


def stream_of(spark, df, tmp_path, parts):
    """The frame as a file stream that delivers one time slice per micro-batch."""
    total = df.count()
    for p in range(parts):
        df.filter((F.col("event_id") >= p * total // parts) & (F.col("event_id") < (p + 1) * total // parts)).coalesce(1).write.parquet(
            f"{tmp_path}/in/slice{p:02d}")
    import time
    import os
    for p in range(parts):  # the file source goes by modification time
        folder = f"{tmp_path}/in/slice{p:02d}"
        for name in os.listdir(folder):
            os.utime(f"{folder}/{name}", (time.time() - 1000 + p, time.time() - 1000 + p))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    """Two admissions a minute; the events at 0 and 10 come after those at 70 and 75."""
    rows = [(0, 70), (1, 75), (2, 0), (3, 10), (4, 80)]
    df = spark.createDataFrame([(i, BASE + dt.timedelta(seconds=s), "u") for i, s in rows], "event_id bigint, ts timestamp_ntz, user string")
    limits = admission.Limits(per_minute=2, cost_per_hour=1.0)
    stream, close = jobs.closable(stream_of(spark, df, tmp_path, 5))
    got = {r.event_id: r.decision for r in spark.read.parquet(jobs.run_to_folder(admission.admit_stream(stream, "user", limits), close=close)).collect()}
    assert got == {2: "admitted", 3: "admitted", 0: "admitted", 1: "admitted", 4: "requests"}


def late(df):
    """Neighbouring events change places, up to five minutes apart."""
    return df.withColumn("event_id", F.row_number().over(W.orderBy(F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.hash("event_id"), F.lit(300)))).cast("bigint") - 1)


def test_admission_stream_equals_batch(spark, tmp_path):
    limits = admission.Limits(per_minute=5, cost_per_hour=1.0)
    _, df = events(spark, 1500, 4)
    df = spark.createDataFrame(late(df).collect(), df.schema)
    stream, close = jobs.closable(stream_of(spark, df, tmp_path, 4))
    path = jobs.run_to_folder(admission.admit_stream(stream, "user", limits, cost="cost * 2"), close=close)
    got = {(r.event_id, r.decision) for r in spark.read.parquet(path).collect()}
    assert got == {(r.event_id, r.decision) for r in admission.admit(df, "user", limits, cost="cost * 2").collect()}


def test_cap_stream_equals_batch(spark, tmp_path):
    _, df = events(spark, 1500, 5)
    df = spark.createDataFrame(late(df).collect(), df.schema)
    stream, close = jobs.closable(stream_of(spark, df, tmp_path, 3))
    path = jobs.run_to_folder(admission.cap_stream(stream, "user", 3), close=close)
    got = {(r.event_id, r.decision) for r in spark.read.parquet(path).collect()}
    assert got == {(r.event_id, r.decision) for r in admission.cap_per_minute(df, "user", 3).collect()}


def test_more_than_a_thousand_admissions_an_hour(spark):
    df = spark.range(1500).select(F.col("id").alias("event_id"), (F.lit(BASE) + F.expr("make_dt_interval(0, 0, 0, id)")).alias("ts"), F.lit("u").alias("user"))
    limits = admission.Limits(per_minute=100, cost_per_hour=12.0)
    assert admission.admit(df, "user", limits).filter("decision = 'admitted'").count() == 1200


def test_counters_stream_equals_batch(spark, tmp_path):
    _, df = events(spark, 1500, 6)
    path = jobs.run_to_folder(jobs.request_counters(stream_of(spark, df, tmp_path, 3)), mode="update")
    got = {(r.window_start, r.requests) for r in jobs.read_latest(spark, path, ["window_start"]).collect()}
    assert got == {(r.window_start, r.requests) for r in jobs.request_counters(df).collect()}


def test_offered_load(spark):
    rows, df = events(spark, 1200, 7)
    got = {r.event_id: (r.requests_last_minute, round(r.cost_last_hour, 6)) for r in admission.offered_load(df, "user", "cost").collect()}
    for i, ts, user, _ in rows:
        mine = [r for r in rows if r[2] == user and r[1] <= ts]
        minute = sum(r[1] > ts - dt.timedelta(seconds=60) for r in mine)
        hour = sum(r[1] > ts - dt.timedelta(hours=1) for r in mine)
        assert got[i] == (minute, round(hour * 0.01, 6))


def test_limiter_travels_without_the_package(tmp_path):
    """A worker that cannot import this package can still run the limiter."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    limiter, limits = admission.SlidingLimiter, admission.Limits()
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(admission._scan(lambda: limiter(limits))))
    code = "import pickle, pandas as pd; f = pickle.load(open('f.pkl', 'rb')); print(next(f(iter([pd.DataFrame({'key': [1], 'piece': [1], 'event_id': [1], 'at': [5], 'cost': [1]})])))['decision'][0])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.stdout.strip() == "admitted", out.stderr
