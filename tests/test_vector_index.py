"""Cosine top-k through cells and rings against the full product."""

import numpy as np
import pytest

from workloom.operators import vector_index as vi


def full(blocks, queries, k):
    out = []
    for q, v in queries:
        v = np.array(v, float) if v is not None else np.zeros(1)
        if not np.linalg.norm(v) > 0:
            continue
        found = []
        for b, x in blocks:
            x = np.array(x, float) if x is not None else np.zeros(1)
            if np.isfinite(x).all() and np.linalg.norm(x) > 0:
                found.append((-round(float(x @ v / np.linalg.norm(x) / np.linalg.norm(v)), 9), b))
        out += [(q, b, -s, rank + 1) for rank, (s, b) in enumerate(sorted(found)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["block_id"], round(r["similarity"], 9), r["rn"]) for r in df.collect())


def frames(spark, blocks, queries):
    return (spark.createDataFrame(blocks, "block_id bigint, vector array<double>"),
            spark.createDataFrame(queries, "query_id bigint, vector array<double>"))


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    blocks = [(i, (centres[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(1500)]
    queries = [(i, (centres[i % 12] + rng.normal(size=16) * 0.3).tolist()) for i in range(70)]
    return blocks, queries


@pytest.mark.parametrize("k", [1, 3, 40])
def test_equals_the_full_product(spark, monkeypatch, clustered, k):
    monkeypatch.setattr(vi, "CHUNK", 20)
    monkeypatch.setattr(vi, "QUERY_CHUNK", 16)
    blocks, queries = clustered
    assert rows(vi.cosine_top_k(*frames(spark, blocks, queries), k)) == full(blocks, queries, k)


def test_far_rings_are_not_visited(spark, clustered):
    blocks, queries = clustered
    b, q = frames(spark, blocks, queries)
    index = vi.vector_index(b)
    unit = q.select("query_id", vi._directed(q["vector"]).alias("vector"))
    near = vi.search(index, q, 3).filter("rn = 3").selectExpr("query_id", "sqrt(2 - 2 * similarity) AS bound")
    visits = vi._visits(unit.join(near, "query_id"), index, 3, again=True).count()
    assert visits < 0.3 * len(queries) * len(index.rings)


def test_vectors_without_direction_ties_and_empty_tables(spark):
    blocks = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.0, 1.0]), (0, [3.0, 0.0])]
    queries = [(1, [5.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, -1.0])]
    b, q = frames(spark, blocks, queries)
    assert rows(vi.cosine_top_k(b, q, 2)) == full(blocks, queries, 2)
    assert vi.cosine_top_k(b, q.limit(0), 2).count() == 0
    assert vi.cosine_top_k(b.limit(0), q, 2).count() == 0
