"""Token counts of flat, unindexed token files by a separator scan.

A token file is a run of 16-bit ids; every document ends with the end-of-document id and nothing
says where. Files are cut into blocks of a fixed number of ids without looking inside. A task reads
a block by range, finds the separators in one vectorised comparison and reports what lies between
them. Documents that cross blocks are stitched by a prefix scan over one row per block: the last
separator before the block, and the number of documents that ended before it. The scan runs in two
levels (inside groups of blocks, then over groups), so a single huge file is no single task.

A tail without a separator is reported as an unfinished document. Empty files and empty documents
(two separators side by side) are counted as they are. Null texts are written as empty documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workloom.llm.arrays import flat, slices
from workloom.llm.byte_pairs import SLICE, encoder
from workloom.llm.shared import file_system, fresh_path, kept, task_count

#: The vocabulary files leave this id free.
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 20
GROUP_BLOCKS = 4096
KIND = np.dtype("<u2")


def write_token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode texts into one token file per task; returns (path, ordinal, doc_id)."""
    folder = fresh_path(docs.sparkSession, "tokens")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, coder = TaskContext.get(), encoder(vocabulary)
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        done = 0
        with fs.open_output_stream(f"{base}/{name}") as sink:
            for batch in batches:
                data, offsets = flat(batch.column("text"))
                for low, high in slices(offsets, SLICE):
                    ids, at = coder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    sink.write(np.insert(ids, at[1:], SEPARATOR).astype(KIND).tobytes())
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{folder}/{name}"] * batch.num_rows, pa.string()),
                    pa.array(np.arange(done, done + batch.num_rows), pa.int64()), batch.column("doc_id"),
                ], ["path", "ordinal", "doc_id"])
                done += batch.num_rows

    rows = docs.select("doc_id", "text").mapInArrow(work, "path string, ordinal bigint, doc_id bigint")
    return kept(rows, "token-manifest")


def file_blocks(paths: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, block: all blocks of all files, from the files' sizes alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path in batch.column("path").to_pylist():
                fs, inner = file_system(path)
                sizes.append(fs.get_file_info(inner).size // KIND.itemsize)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "n_ids"])

    sized = paths.select("path").distinct().mapInArrow(work, "path string, n_ids bigint")
    last = F.floor((F.col("n_ids") - 1) / block_tokens).cast("bigint")
    return sized.filter("n_ids > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per block: its number of ids, and the places of its separators, counted from the file's begin."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist()):
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as source:
                    raw = source.read_at(block_tokens * KIND.itemsize, block * block_tokens * KIND.itemsize)
                ids = np.frombuffer(raw, KIND, len(raw) // KIND.itemsize)
                ends = np.flatnonzero(ids == separator) + block * block_tokens
                yield pa.RecordBatch.from_arrays([
                    pa.array([path], pa.string()), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.array(ends, pa.int64())),
                ], ["path", "block", "n_ids", "ends"])

    return blocks.repartition(task_count(blocks.sparkSession), "path", "block").mapInArrow(
        work, "path string, block bigint, n_ids bigint, ends array<bigint>")


def stitched(scanned: DataFrame) -> DataFrame:
    """One row per document: path, ordinal, start, n_tokens (without the separator), finished."""
    short = scanned.select(
        "path", "block", F.floor(F.col("block") / GROUP_BLOCKS).cast("bigint").alias("grp"), "n_ids",
        F.size("ends").cast("bigint").alias("n_ends"), F.get("ends", F.size("ends") - 1).alias("last"))
    groups = short.groupBy("path", "grp").agg(F.sum("n_ends").alias("n_ends"), F.max("last").alias("last"))
    earlier = W.partitionBy("path").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    carried = groups.select(
        "path", "grp", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("done0"),
        F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("last0"))
    inside = W.partitionBy("path", "grp").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = (
        short.select(
            "path", "grp", "block", F.coalesce(F.sum("n_ends").over(inside), F.lit(0)).alias("done1"),
            F.max("last").over(inside).alias("last1"))
        .join(carried, ["path", "grp"])
        .select("path", "block", (F.col("done0") + F.col("done1")).alias("done"),
                F.coalesce("last1", "last0").alias("last"))
    )
    bounded = scanned.join(before, ["path", "block"])
    whole = bounded.select("path", "done", "last", "ends", F.posexplode("ends").alias("k", "end")).select(
        "path", (F.col("done") + F.col("k")).alias("ordinal"),
        (F.when(F.col("k") == 0, F.col("last")).otherwise(F.get("ends", F.col("k") - 1)) + 1).alias("start"), "end",
    ).select("path", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("finished"))
    totals = short.groupBy("path").agg(
        F.sum("n_ends").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.sum("n_ids").alias("n_ids"))
    rest = totals.filter("n_ids > start").select(
        "path", "ordinal", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("finished"))
    return whole.unionByName(rest)


def token_counts(paths: DataFrame, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of the token files named in ``path``, with their numbers of tokens."""
    blocks = file_blocks(paths, block_tokens)
    return stitched(kept(scan_blocks(blocks, separator, block_tokens), "separators"))
