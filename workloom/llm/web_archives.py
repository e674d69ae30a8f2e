"""Web archives inside ZIP packages: written as WARC records, read back without extraction.

Writing: pages with equal payloads are found by digest; the page with the largest id becomes the
response, the others become revisits that name it. Every task writes its records, one gzip member
each, into stored members of ZIP packages in the shared folder, with an index of record offsets as
a second stored member. The manifest lists only packages of tasks that ended well.

Reading: a task per package parses the end record, the ZIP64 end record where there is one, and the
central directory; local headers give the offsets of stored members. Index lines become rows
(path, offset, length), which are spread over all tasks and read by range. A package without an
index is walked record by record instead.

Null html counts as empty. Pages without an id are written and read back with a null id; they
refer to the largest id among equal payloads, and are responses where there is none. Rows that
share the largest id of a payload are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloom.llm.shared import file_system, fresh_path, kept, task_count

#: Payloads below this size are always written in full.
LEAST_BYTES = 1000
PACKAGE_BYTES = 64 << 20
ARCHIVE, INDEX = "archive/pages.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP ---------------------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int  # 0: stored
    size: int
    stored_size: int
    header: int  # offset of the local header


class BadArchive(ValueError):
    """The bytes are not a readable ZIP package."""


def _end_record(source, size: int) -> tuple[int, int, int]:
    """Offset and size of the central directory, and the number of its entries."""
    tail_size = min(size, 22 + 65535)
    tail = source.read_at(tail_size, size - tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") > len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0 or len(tail) < at + 22:
        raise BadArchive("no end of central directory")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    locator = size - tail_size + at - 20
    if locator >= 0 and (entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF):
        found = source.read_at(20, locator)
        if found[:4] == b"PK\x06\x07":
            wide = source.read_at(56, struct.unpack_from("<Q", found, 8)[0])
            if wide[:4] != b"PK\x06\x06":
                raise BadArchive("no ZIP64 end record")
            entries, length, offset = struct.unpack_from("<QQQ", wide, 32)
    if offset + length > size:
        raise BadArchive("central directory beyond the end")
    return offset, length, entries


def members(source, size: int) -> list[Member]:
    """The central directory of a package; sizes and offsets come from ZIP64 fields if they overflow."""
    offset, length, entries = _end_record(source, size)
    data, at, out = source.read_at(length, offset), 0, []
    for _ in range(entries):
        if data[at : at + 4] != b"PK\x01\x02":
            raise BadArchive("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = k + 4
                if plain == 0xFFFFFFFF:
                    plain, wide = struct.unpack_from("<Q", extra, wide)[0], wide + 8
                if stored == 0xFFFFFFFF:
                    stored, wide = struct.unpack_from("<Q", extra, wide)[0], wide + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, wide)[0]
            k += 4 + width
        out.append(Member(name, method, plain, stored, header))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(source, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    head = source.read_at(30, member.header)
    if head[:4] != b"PK\x03\x04" or member.method != 0:
        raise BadArchive(f"{member.name} is not stored")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


class _Stream:
    """An output stream without seeking, for the ZIP writer; counts its bytes."""

    def __init__(self, sink):
        self.sink, self.size = sink, 0

    def write(self, data) -> int:
        self.sink.write(bytes(data))
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


# --- WARC --------------------------------------------------------------------------------------


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC record of a page, uncompressed."""
    payload = (row["html"] or "").encode("utf-8")
    own = "" if row["page_id"] is None else row["page_id"]
    revisit = row["refers_to"] is not None
    url = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in row["url"] or "")
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode("ascii")
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode("ascii")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{own}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Target-URI: {url}"] if url else []),
        *([f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def parse_record(data: bytes) -> dict:
    """Fields of a record; the digest of a response is taken anew from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise BadArchive("no WARC record here")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != stated:
            raise BadArchive("the payload does not fit its digest")
    else:
        size, digest = int(_headers(http)["content-length"]), stated

    def page(name: str) -> int | None:
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {"page_id": page("warc-record-id"), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": page("warc-refers-to"),
            "url": fields.get("warc-target-uri"),
            "payload": payload if fields["warc-type"] == "response" else None}


def walk(source, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member in a range, for packages without an index."""
    at = start
    while at < start + size:
        unzip, read, over = zlib.decompressobj(31), at, False
        while not over:
            data = source.read_at(min(step, start + size - read), read)
            if not data:
                raise BadArchive("a record is cut off")
            unzip.decompress(data)
            read += len(data)
            over = unzip.eof
        end = read - len(unzip.unused_data)
        yield at, end - at
        at = end


# --- jobs --------------------------------------------------------------------------------------


def with_references(pages: DataFrame) -> DataFrame:
    """Pages with their payload digest and, for revisits, the page that holds the payload."""
    own = pages.select(
        "page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
        F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    last = (
        own.filter(F.col("size") >= LEAST_BYTES).groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return own.join(last, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages as ZIP-packaged WARC; returns the manifest (path, n_records, n_bytes)."""
    folder = fresh_path(pages.sparkSession, "archives")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        state: dict = {"k": 0}

        def begin() -> None:
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{state['k']:04d}.zip"
            sink = fs.open_output_stream(f"{base}/{name}")
            out = _Stream(sink)
            package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
            state.update(name=name, sink=sink, out=out, package=package, at=0, lines=[],
                         member=package.open(ARCHIVE, "w", force_zip64=True))

        def finish() -> dict:
            state["member"].close()
            with state["package"].open(INDEX, "w") as index:
                index.write("".join(state["lines"]).encode("ascii"))
            state["package"].close()
            state["sink"].close()
            state["k"] += 1
            return {"path": f"{folder}/{state['name']}", "n_records": len(state["lines"]), "n_bytes": state["out"].size}

        open_ = False
        for batch in batches:
            done = []
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if not open_:
                    begin()
                    open_ = True
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = pack.compress(record_bytes(row, date)) + pack.flush()
                state["member"].write(data)
                state["lines"].append(json.dumps({"offset": state["at"], "length": len(data)}) + "\n")
                state["at"] += len(data)
                if state["at"] >= PACKAGE_BYTES:
                    done.append(finish())
                    open_ = False
            if done:
                yield pa.RecordBatch.from_pylist(done, MANIFEST)
        if open_:
            yield pa.RecordBatch.from_pylist([finish()], MANIFEST)

    return kept(with_references(pages).mapInArrow(work, "path string, n_records bigint, n_bytes bigint"), "manifest")


MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
PLACES = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORDS = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
           "refers_to bigint, url string, payload binary")


def record_places(paths: DataFrame, rows: int = 50_000) -> DataFrame:
    """Where each record lies: path, offset, length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = file_system(path)
                with fs.open_input_file(inner) as source:
                    found = {m.name: m for m in members(source, source.size())}
                    for name, member in found.items():
                        if not name.startswith("archive/") or not name.endswith(".warc.gz"):
                            continue
                        start, index = data_offset(source, member), found.get(INDEX)
                        if index is not None:
                            lines = source.read_at(index.stored_size, data_offset(source, index)).splitlines()
                            places = ((start + e["offset"], e["length"]) for e in map(json.loads, lines))
                        else:
                            places = walk(source, start, member.stored_size)
                        part: list[dict] = []
                        for offset, length in places:
                            part.append({"path": path, "offset": offset, "length": length})
                            if len(part) >= rows:
                                yield pa.RecordBatch.from_pylist(part, PLACES)
                                part = []
                        yield pa.RecordBatch.from_pylist(part, PLACES)

    return paths.select("path").repartition(task_count(paths.sparkSession), "path").mapInArrow(
        work, "path string, offset bigint, length bigint")


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all packages, read by range on all tasks."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, source = None, None
        for batch in batches:
            rows, held = [], 0
            for place in batch.to_pylist():
                if place["path"] != path:
                    if source is not None:
                        source.close()
                    path = place["path"]
                    fs, inner = file_system(path)
                    source = fs.open_input_file(inner)
                data = zlib.decompress(source.read_at(place["length"], place["offset"]), 31)
                record = parse_record(data)
                if not payloads:
                    record["payload"] = None
                rows.append(record)
                held += len(record["payload"] or b"")
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if source is not None:
            source.close()

    spread = record_places(paths).repartition(task_count(paths.sparkSession), "path", "offset").sortWithinPartitions(
        "path", "offset")
    return spread.mapInArrow(work, RECORDS)
