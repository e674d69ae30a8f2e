"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Documents are cut into shards of about ``SHARD_BYTES`` of text (or of one text where it is longer).
One pass over the texts writes, per shard and term that some item asks for, the documents and
occurrences of the term; document frequencies and corpus sizes are sums over that table and cover
all rows. Items are dealt into blocks, and each shard meets each block of items once: a task sorts
the shard's lists by impact and runs NRA for every item of the block.

NRA reads all lists of an item from the top, deeper in each round. A document's score lies between
the sum of the impacts read so far and that sum plus, for every list it has not been seen in, the
impact that comes next there. Documents not seen at all lie below the sum of these next impacts.
Reading goes on until no unseen document can enter, every document that may still reach the k-th
score has a closed interval, and ties are decided. So each shard's best k are exact, and the best k of
all shards are the best k of the shards' best; Spark keeps k rows per item before it shuffles them.

The terms of the items reach the scan as a bitmap of bounded size, which only lets too much through;
the join on the term itself decides. Every row of ``documents`` and of the items counts on its own,
also when ids repeat; rows without id rank behind equal scores with one. Null and empty texts have
no terms; an item without terms, or without a document that shares one, has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workloom.llm.arrays import (
    SIGNS, byte_codes, find_words, flat, list_array, signed, slices, small_letters, span_hashes, strings,
)
from workloom.llm.bitmap import Bitmap
from workloom.llm.shared import kept

BEST = 10
SHARD_BYTES = 8 << 20
#: Items a task ranks against one shard, on average.
ITEM_BLOCK = 256
#: Postings read of each list in the first round; each round reads GROW times as many.
FIRST_DEPTH, GROW = 64, 4


def terms_of(data: np.ndarray, offsets: np.ndarray, keep=None):
    """The terms of a slice of texts: distinct ones, the number of each occurrence's, its row, and all
    occurrences per row. ``keep`` may drop occurrences by hash; the counts per row are of all."""
    data = small_letters(data)
    words = find_words(data, offsets, SIGNS)
    start, end, row = words.start, words.end, words.doc
    if keep is not None:
        stay = keep(signed(span_hashes(data, start, end, byte_codes(fold_case=False))))
        start, end, row = start[stay], end[stay], row[stay]
    coded = strings(data, start, end).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), row, np.diff(words.first)


def counted(number: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, rows and occurrences of every distinct (term, row), by term."""
    key, n = np.unique(number.astype(np.int64) * max(rows, 1) + row, return_counts=True)
    return key // max(rows, 1), key % max(rows, 1), n


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times, hash): the terms of each row of the items; ``item`` numbers rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets):
                distinct, number, row, _ = terms_of(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                term, at, n = counted(number, row, high - low)
                flat_terms, bounds = flat(distinct)
                hashes = signed(span_hashes(flat_terms, bounds[:-1], bounds[1:], byte_codes(fold_case=False)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").slice(low).take(pa.array(at)), batch.column("item_id").slice(low).take(pa.array(at)),
                     distinct.take(pa.array(term)).cast(pa.binary()), pa.array(n.astype(np.int64)), pa.array(hashes[term])],
                    ["item", "item_id", "term", "times", "hash"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInArrow(
        work, f"item bigint, item_id {kind}, term binary, times bigint, hash bigint")


def postings(docs: DataFrame, asked: Bitmap) -> DataFrame:
    """Per shard one row with (ids, n) of its documents and no term, and a row (term, rows, tf) per
    term that passes the bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets, SHARD_BYTES):
                distinct, number, row, sizes = terms_of(
                    data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], asked.has)
                term, at, n = counted(number, row, high - low)
                per_term = np.bincount(term, minlength=len(distinct))
                lists, none = len(distinct), pa.nulls(1, pa.binary())
                empty = np.zeros(lists + 1, np.int64)
                empty[0] = high - low  # documents stand in the first row only
                per_row = np.concatenate(([0], per_term))
                ids = batch.column("doc_id").slice(low, high - low).cast(pa.int64())
                bounds = pa.array(np.concatenate(([0], np.cumsum(empty))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(lists + 1, shard)), pa.concat_arrays([none, distinct.cast(pa.binary())]),
                    pa.ListArray.from_arrays(bounds, ids), pa.ListArray.from_arrays(bounds, pa.array(sizes, pa.int64())),
                    list_array(at, per_row, pa.int32()), list_array(n, per_row, pa.int32()),
                ], ["shard", "term", "ids", "n", "rows", "tf"])
                shard += 1

    return docs.select("doc_id", "text").mapInArrow(
        work, "shard bigint, term binary, ids array<bigint>, n array<bigint>, rows array<int>, tf array<int>")


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (below ``size``) that belong to the k best or tie with the last of them, and their scores.

    ``lists`` hold rows and impacts, highest impact first, and each row once at most.
    """
    lower = np.zeros(size, np.int64)
    seen = np.zeros((len(lists), size), bool)
    ends = np.array([len(rows) for rows, _ in lists])
    at = np.zeros(len(lists), np.int64)
    following = np.array([impacts[0] if len(impacts) else 0 for _, impacts in lists], np.int64)
    candidates, entering, depth = np.arange(size), True, FIRST_DEPTH
    while True:
        for t in np.flatnonzero(at < ends).tolist():
            if not entering and seen[t, candidates].all():
                continue
            rows, impacts = lists[t]
            part = slice(at[t], at[t] + depth)
            lower[rows[part]] += impacts[part]
            seen[t, rows[part]] = True
            at[t] = min(at[t] + depth, ends[t])
            following[t] = impacts[at[t]] if at[t] < ends[t] else 0
        depth *= GROW
        low = lower[candidates]
        least = max(1, int(np.partition(low, -k)[-k])) if len(low) > k else 1
        upper = low + following @ ~seen[:, candidates]
        stay = upper >= least
        # Rows not seen yet are candidates too until the next impacts together stay below the k-th score.
        entering = entering and int(following.sum()) >= least
        candidates, low, upper = candidates[stay], low[stay], upper[stay]
        if not entering and (low == upper).all():
            return candidates, low


def _best(ids: np.ndarray, missing: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids[rows], missing[rows], -scores))[:k]


def shard_best(group: pa.Table, n_docs: int, n_terms: int, k: int) -> pa.Table:
    """item, doc_id and score of the k best documents of one shard, for all items of one block."""
    head = group.filter(group.column("term").is_null())
    lists = group.filter(group.column("term").is_valid())
    ids = head.column("ids").combine_chunks().flatten()
    missing, ids = np.array(ids.is_null()), ids.fill_null(0).to_numpy()
    sizes = head.column("n").combine_chunks().flatten().to_numpy()
    m = 25 + (75 * sizes * n_docs) // max(n_terms, 1)
    asked: dict[int, list[tuple[int, int]]] = {}
    sorted_lists = []
    columns = [lists.column(c).combine_chunks() for c in ("rows", "tf", "items", "times")]
    for number, weight in enumerate(lists.column("w").to_pylist()):
        rows, tf, items, times = (c[number].values.to_numpy() for c in columns)
        tf = tf.astype(np.int64)
        impacts = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[rows]))
        order = np.argsort(-impacts, kind="stable")
        sorted_lists.append((rows[order], impacts[order]))
        for item, n in zip(items.tolist(), times.tolist()):
            asked.setdefault(item, []).append((number, n))
    out: list[tuple[np.ndarray, ...]] = []
    for item, own in asked.items():
        rows, scores = nra([(sorted_lists[t][0], sorted_lists[t][1] * n) for t, n in own], len(ids), k)
        best = _best(ids, missing, rows, scores, k)
        out.append((np.full(len(best), item), ids[rows[best]], missing[rows[best]], scores[best]))
    parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
    return pa.table({"item": pa.array(parts[0], pa.int64()), "doc_id": pa.array(parts[1], pa.int64(), mask=parts[2]),
                     "score": pa.array(parts[3], pa.int64())})


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * df + 1))).cast("bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    asked = kept(item_terms(items), "item-terms")
    index = kept(postings(docs, Bitmap.of(asked, "hash")), "postings")
    sizes = F.explode("n").alias("n")
    n_docs, n_terms = index.filter("term IS NULL").select(sizes).filter("n > 0").agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-asked.select("item").distinct().count() // ITEM_BLOCK))
    frequency = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("rows")).alias("df"))
    by_block = asked.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "term").agg(
        F.collect_list(F.struct("item", "times")).alias("x"))  # at most the items of a block
    wanted = by_block.join(frequency, "term").select(
        "term", "block", weight(n_docs, F.col("df")).alias("w"), F.col("x.item").alias("items"), F.col("x.times").alias("times"))
    lists = index.filter("term IS NOT NULL").select("shard", "term", "rows", "tf").join(wanted, "term")
    heads = index.filter("term IS NULL").select(
        "shard", "ids", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))

    def work(group: pa.Table) -> pa.Table:
        return shard_best(group, n_docs, n_terms, k)

    found = lists.unionByName(heads, allowMissingColumns=True).groupBy("shard", "block").applyInArrow(
        work, "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select("item", "item_id").distinct()
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
