"""Folders of many small files, written, listed and read by the tasks.

Neither the names nor the contents of the files pass through the driver: it only looks at the
upper levels of a folder, until there are enough folders to share out, and each task walks its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a task reads before it passes it on.
BATCH_BYTES, BATCH_FILES = 16 << 20, 1000


def file_system(path: str):
    """The file system of a path or URI, and the path inside it; imported on the worker."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def task_count(spark: SparkSession) -> int:
    """Tasks for rows that are small but stand for much work, such as places in files. Given as a
    number, it keeps the adaptive planner from packing them into few tasks by their own size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _children(fs, folder: str):
    """(folders, files) of one level, without hidden ones and empty files."""
    from pyarrow.fs import FileSelector, FileType

    found = [x for x in fs.get_file_info(FileSelector(folder)) if not _hidden(x.base_name)]
    return [x.path for x in found if x.type == FileType.Directory], [x for x in found if x.type == FileType.File and x.size]


def folders(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """(path, deep): folders whose files, or whose whole trees (deep), are the files below a folder."""
    fs, base = file_system(folder)
    wanted = task_count(spark)
    flat, deep = ([], [base]) if recursive else ([base], [])
    while deep and len(flat) + len(deep) < wanted:
        flat, deep = flat + deep, [child for parent in deep for child in _children(fs, parent)[0]]
    rows = [(x, False) for x in flat] + [(x, True) for x in deep]
    return spark.createDataFrame(rows, "path string, deep boolean").repartition(min(len(rows), wanted))


def listed_files(
    spark: SparkSession, folder: str, pattern: str, recursive: bool = True, max_bytes: int | None = None,
) -> DataFrame:
    """(path, length, content) of the files below a folder whose names match a pattern with ``*``, ``?`` and
    ``[…]``. The content of files over ``max_bytes`` is not read and null."""
    fs, base = file_system(folder)
    scheme = "file:" if fs.type_name == "local" else folder[: folder.index("://") + 3] + folder.split("://", 1)[1].split("/")[0]
    local = fs.type_name == "local"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)

        def walk(path: str, deep: bool):
            open_folders = [path]
            while open_folders:
                inner, files = _children(fs, open_folders.pop())
                yield from (x for x in files if fnmatchcase(x.base_name, pattern))
                open_folders += inner if deep else []

        def rows(items: list) -> pa.RecordBatch:
            paths, lengths, contents = zip(*items)
            return pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(contents, pa.binary())],
                ["path", "length", "content"])

        items, held = [], 0
        for batch in batches:
            for start in batch.to_pylist():
                for x in walk(start["path"], start["deep"]):
                    content = None
                    if max_bytes is None or x.size <= max_bytes:
                        with fs.open_input_stream(x.path) as source:
                            content = source.read()
                        held += len(content)
                    items.append((scheme + (x.path if local else "/" + x.path.split("/", 1)[-1]), x.size, content))
                    if held >= BATCH_BYTES or len(items) >= BATCH_FILES:
                        yield rows(items)
                        items, held = [], 0
        if items:
            yield rows(items)

    return folders(spark, folder, recursive).mapInArrow(work, "path string, length bigint, content binary")


def write_keyed(df: DataFrame, path: str, key: str, text: str) -> None:
    """One file per key, ``shard=…/key=…/part.txt`` below a folder, with the texts of the key and a line end
    after each. Whatever was there goes first. A file is written under a hidden name and renamed, so a
    repeated task leaves the same files."""
    from pyspark.sql.types import BinaryType

    shards = task_count(df.sparkSession)
    named = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = df.filter(F.col(text).isNotNull()).select(named.alias("key"), F.col(text).cast(BinaryType()).alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(shards, "shard")
    fs, base = file_system(path)
    fs.create_dir(base, recursive=True)
    fs.delete_dir_contents(base)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from urllib.parse import quote

        from pyspark import TaskContext

        fs, base = file_system(path)
        attempt = TaskContext.get().taskAttemptId()
        last, sink, folder, done = None, None, "", 0

        def close():
            if sink is not None:
                sink.close()
                fs.move(f"{folder}/.part-{attempt}", f"{folder}/part.txt")

        for batch in batches:
            for shard, name, content in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "text"))):
                if name != last:
                    close()
                    folder, last, done = f"{base}/shard={shard}/{key}={quote(name, safe=' ')}", name, done + 1
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(f"{folder}/.part-{attempt}")
                sink.write(content + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["files"])

    rows.sortWithinPartitions("shard", "key").mapInArrow(work, "files bigint").write.format("noop").mode("overwrite").save()
