"""Bucketed ranking and token budgets against brute force, with a hot group."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workloom.operators import budget, ranking, retrieval
from workloom.operators.vector_index import cosine_top_k


def frame(spark, n=3000, seed=1, sizes=(0, 1, 2, 3, 5, 8, 40, 90, 300)):
    rnd = random.Random(seed)
    rows = [(i, "hot" if rnd.random() < 0.4 else rnd.choice(["g0", "g1", "g2", None]), rnd.randrange(50), rnd.choice(sizes), rnd.choice([10, 20, 40])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, g string, score int, tokens int, priority int")


def test_row_number_and_lag(spark):
    _, df = frame(spark)
    order = [F.col("score"), F.col("id")]
    w = W.partitionBy("g").orderBy(*order)
    plain = df.select("id", F.row_number().over(w).alias("rn"), F.lag("id").over(w).alias("before"))
    rn = ranking.row_number_by_bucket(df, ["g"], F.floor(F.col("score") / 7), order).select("id", "rn")
    prev = ranking.previous_row(df, ["g"], F.floor(F.col("score") / 7), order, ["id"], "p").select("id", F.col("p.id").alias("before"))
    got = {r.id: (r.rn, r.before) for r in rn.join(prev, "id").collect()}
    assert got == {r.id: (r.rn, r.before) for r in plain.collect()}


def test_top_k(spark):
    rows, df = frame(spark)
    got = {(r.g, r.id, r.rn) for r in ranking.top_k(df, ["g"], [F.desc("score"), F.col("id")], 4, ranking.spread_by("id")).collect()}
    want = set()
    for g in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:4]
        want |= {(g, r[0], i + 1) for i, r in enumerate(best)}
    assert got == want


def greedy(rows, limit):
    """(skip pass over critical rows, then stop-at-overflow over the rest)"""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    used, first = 0, []
    for r in rows:
        if r[4] <= 10 and used + r[3] <= limit:
            first.append(r[0])
            used += r[3]
    second = []
    for r in rows:
        if r[0] in first:
            continue
        if used + r[3] > limit:
            break
        second.append(r[0])
        used += r[3]
    return set(first), set(second)


def test_budgets(spark):
    for seed, limit, sizes in ((1, 60, (0, 1, 2, 3, 5, 8, 40, 90)), (2, 500, (1, 7, 20, 300)), (3, 25, (30, 40)), (4, 100, (0, 99, 1, 2))):
        rows, df = frame(spark, 1200, seed, sizes)
        got = retrieval.select_sections(df, ["g"], ["id"], limit).collect()
        for g in {r[1] for r in rows}:
            first, second = greedy([r for r in rows if r[1] == g], limit)
            assert {r.id for r in got if r.g == g and r["pass"] == 1} == first
            assert {r.id for r in got if r.g == g and r["pass"] == 2} == second


def test_stop_only(spark):
    rows, df = frame(spark, 900, 9)
    got = {r.id for r in budget.take_until_overflow(df, ["g"], F.struct("score", "id"), "tokens", ["id"], 77).collect()}
    want = set()
    for g in {r[1] for r in rows}:
        used = 0
        for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            if used + r[3] > 77:
                break
            used += r[3]
            want.add(r[0])
    assert got == want


def test_cosine_top_k(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    blocks, queries = rng.normal(size=(400, 8)), rng.normal(size=(5, 8))
    b = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(blocks)], "block_id bigint, vector array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "query_id bigint, vector array<double>")
    got = {(r.query_id, r.rn): r.block_id for r in cosine_top_k(b, q, 4).collect()}
    sims = blocks @ queries.T / np.linalg.norm(blocks, axis=1)[:, None] / np.linalg.norm(queries, axis=1)
    want = {(j, k + 1): int(i) for j in range(5) for k, i in enumerate(np.argsort(-sims[:, j])[:4])}
    assert got == want
