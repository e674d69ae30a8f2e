"""Exact cosine top-k through an index of cells and rings.

Vectors are scaled to length one, where the largest cosine is the smallest distance. Each vector
belongs to the cell of its nearest centroid and, by its distance from the centroid, to one of the
cell's rings; a ring is cut into chunks of about CHUNK vectors. A query at distance d from a centroid
is at least max(least - d, d - most) away from every vector of a ring that reaches from ``least`` to
``most`` (triangle inequality).

A search first visits the rings that surely hold k vectors near the query; the k-th distance found
there bounds the result, and only rings whose least distance does not exceed it are visited then.
Queries travel in chunks as well, and Spark brings query chunks and vector chunks together, so no
query passes through the driver and no vector is read more often than its chunk is visited. What the
driver holds is bounded: MAX_CELLS centroids, learned on a sample of SAMPLE vectors per cell, and
RINGS distances for each.

Vectors that are null, of length zero or not finite have no direction: as blocks they are never
found, as queries they have no rows. Equal similarities rank by block_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.operators.ranking import spread_by, top_k
from workloom.session import written

MAX_CELLS, SAMPLE, STEPS = 1024, 8, 4
RINGS = 8
CHUNK, QUERY_CHUNK = 4096, 1024
#: Distances may be off by rounding; a ring is left out only if it is farther than that.
SLACK = 1e-9


class Ring(NamedTuple):
    cell: int
    ring: int
    count: int
    least: float
    most: float

    @property
    def chunks(self) -> int:
        return -(-self.count // CHUNK)


class VectorIndex(NamedTuple):
    lists: DataFrame  # cell, ring, chunk, block_id, vector (of length one)
    centroids: np.ndarray
    rings: list[Ring]


def _directed(vector: Column) -> Column:
    """The vector scaled to length one, null if it has no direction."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((length > 0) & (length < float("inf")), F.transform(v, lambda x: x / length))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = (vectors @ centroids.T).argmax(1)
    return cell, np.sqrt(((vectors - centroids[cell]) ** 2).sum(1))


def _learned(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of a sample by a few steps of assigning and averaging."""
    centroids = sample[:cells].copy()
    for _ in range(STEPS if len(sample) else 0):
        cell, _ = _nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        length = np.sqrt((sums**2).sum(1, keepdims=True))
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def vector_index(blocks: DataFrame) -> VectorIndex:
    """The index of (block_id, vector); written to the shared folder."""
    units = blocks.select("block_id", _directed(F.col("vector")).alias("vector")).filter("vector IS NOT NULL")
    n = units.count()
    cells = min(MAX_CELLS, max(1, int(n**0.5) // 4))
    first = units.orderBy(F.xxhash64("block_id"), "block_id", "vector").limit(cells * SAMPLE).select("vector").toArrow()
    sample = _matrix(first.column("vector"))
    centroids = _learned(sample, cells)
    # Rings are cut where the distances of the sample's own vectors have their quantiles.
    cell, away = _nearest(sample, centroids) if len(sample) else (np.zeros(0, int), np.zeros(0))
    steps = np.arange(1, RINGS) / RINGS
    cuts = np.array([np.quantile(away[cell == c] if (cell == c).any() else away, steps) for c in range(len(centroids))])
    kind = units.schema["block_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell, away = _nearest(_matrix(batch.column("vector")), centroids)
                ring = (cuts[cell] < away[:, None]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(ring, pa.int32()), pa.array(away)],
                    ["block_id", "vector", "cell", "ring", "away"])

    ringed = written(units.mapInArrow(place, f"block_id {kind}, vector array<double>, cell int, ring int, away double"))
    rings = [Ring(*r) for r in ringed.groupBy("cell", "ring").agg(
        F.count("*").alias("count"), F.min("away").alias("least"), F.max("away").alias("most")).collect()]
    sizes = ringed.sparkSession.createDataFrame(
        [(r.cell, r.ring, r.chunks) for r in rings], "cell int, ring int, chunks int")
    lists = ringed.join(sizes, ["cell", "ring"]).select(
        "cell", "ring", F.pmod(F.xxhash64("block_id"), "chunks").cast("int").alias("chunk"), "block_id", "vector")
    return VectorIndex(lists, centroids, rings)


def _visits(queries: DataFrame, index: VectorIndex, k: int, again: bool) -> DataFrame:
    """(query_id, vector, cell, ring, chunk): what each query visits first, or, given the distance
    ``bound`` of its k-th neighbour so far, what else may hold a nearer vector."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centroids, index.rings))
    kind = queries.schema["query_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, rings = sent.value
        cell, ring, count, least, most = (np.array(x) for x in zip(*rings)) if rings else [np.zeros(0, np.int64)] * 5
        chunks = -(-count // CHUNK)
        for batch in batches:
            if not len(batch) or not len(cell):
                continue
            vectors = _matrix(batch.column("vector"))
            row, at = [], []
            for k0 in range(len(vectors)):
                away = np.sqrt(((centroids - vectors[k0]) ** 2).sum(1))[cell]
                # The rings that come first by their farthest vector hold k vectors for certain.
                order = np.argsort(away + most, kind="stable")
                first = order[: int(np.searchsorted(np.cumsum(count[order]), k)) + 1]
                if again:
                    nearest = np.maximum(np.maximum(least - away, away - most), 0)
                    bound = batch.column("bound")[k0].as_py()
                    first = np.setdiff1d(np.flatnonzero(nearest <= (np.inf if bound is None else bound) + SLACK), first)
                row.append(np.full(len(first), k0))
                at.append(first)
            row, at = np.concatenate(row), np.concatenate(at)
            # One row per chunk of every ring.
            row, at = np.repeat(row, chunks[at]), np.repeat(at, chunks[at])
            new = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1]))) if len(row) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
            taken = batch.select(["query_id", "vector"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, *(pa.array(x, pa.int32()) for x in (cell[at], ring[at], np.arange(len(row)) - start))],
                ["query_id", "vector", "cell", "ring", "chunk"])

    return queries.mapInArrow(work, f"query_id {kind}, vector array<double>, cell int, ring int, chunk int")


def _found(visits: DataFrame, index: VectorIndex, k: int, portions: int) -> DataFrame:
    """(query_id, block_id, similarity): the k best of every visited chunk."""
    place = ["cell", "ring", "chunk"]
    asking = visits.withColumn("portion", F.pmod(F.xxhash64("query_id"), F.lit(portions)).cast("int"))
    wanted = asking.select(*place, F.col("portion").alias("part")).distinct()
    asked = index.lists.join(wanted, place)
    kinds = [f.dataType.simpleString() for f in (visits.schema["query_id"], index.lists.schema["block_id"])]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = right.sort_by("block_id")  # so that the first of equal similarities has the least id
        close = _matrix(left.column("vector")) @ _matrix(blocks.column("vector")).T if len(right) else np.zeros((len(left), 0))
        n = min(k, close.shape[1])
        if n < close.shape[1]:
            least = -np.partition(-close, n - 1, axis=1)[:, n - 1 : n]
        else:
            least = np.full((len(close), 1), -np.inf)
        row, at = np.nonzero(close >= least)  # ties with the last one are cut off below
        order = np.lexsort((at, -close[row, at], row))
        row, at = row[order], at[order]
        place_in_row = np.arange(len(row)) - np.searchsorted(row, row)
        row, at = row[place_in_row < k], at[place_in_row < k]
        return pa.table({"query_id": left.column("query_id").take(pa.array(row)), "block_id": blocks.column("block_id").take(pa.array(at)),
                         "similarity": pa.array(close[row, at], pa.float64())})

    return asking.groupBy(*place, "portion").cogroup(asked.groupBy(*place, "part")).applyInArrow(
        work, f"query_id {kinds[0]}, block_id {kinds[1]}, similarity double")


def search(index: VectorIndex, queries: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest blocks per (query_id, vector), with similarity and rank rn."""
    asked = written(queries.select("query_id", _directed(F.col("vector")).alias("vector")).filter("vector IS NOT NULL"))
    portions = max(1, -(-asked.count() // QUERY_CHUNK))
    order = [F.desc("similarity"), F.col("block_id")]
    best = lambda df: top_k(df, ["query_id"], order, k, spread_by("block_id"))
    near = written(best(_found(_visits(asked, index, k, again=False), index, k, portions)))
    last = F.when(F.count("*") == k, F.min("similarity"))
    bounds = near.groupBy("query_id").agg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * last)).alias("bound"))
    bounded = asked.join(bounds, "query_id", "left").select("query_id", "vector", "bound")
    more = _found(_visits(bounded, index, k, again=True), index, k, portions)
    return best(near.drop("rn").unionByName(more))


def cosine_top_k(blocks: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    return search(vector_index(blocks), queries, k)
