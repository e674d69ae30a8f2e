"""Byte-level BPE on padded numpy matrices: encoding by a rank file, and decoding.

A slice of texts becomes code points, code points become classes, and class changes become the
pieces that the tokenizers' split pattern would match (``piece_starts``). Distinct pieces that are
no token themselves are laid out as rows of byte ids, bucketed by length. In each round every row
looks up the ranks of its neighbouring pairs in a hash table, merges its leftmost pair of minimum
rank, and closes the gap; rows without a known pair leave the matrix. Pieces beyond ``LONG`` bytes
take the same merges one at a time through a heap, because rounds times length grows with the
square.

Null or empty texts have no ids. The vocabulary file is a parameter: a path every worker can read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from workloom.llm.arrays import flat, gather, per_process, slices, strings

LONG = 512
#: A cache of encoded pieces per worker process is emptied beyond this many pieces or bytes of them.
CACHE_PIECES, CACHE_BYTES = 300_000, 1 << 26
MATRIX_CELLS = 1 << 18
#: Bytes of text encoded at once: enough new pieces for a matrix of many rows, and little that a worker keeps.
SLICE = 1 << 19
#: Bytes of decimal ids or decoded texts joined at once.
JOINED = 1 << 18

NEVER = np.int32(np.iinfo(np.int32).max)
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: Code points with the property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that the split pattern cuts off behind an apostrophe, in the pattern's order.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


#: Letters and numbers that the tokenizer's Unicode version has beyond Python's, as
#: ranges with both ends.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


def _classes() -> np.ndarray:
    """The class of every code point, as of Unicode 16 (a worker's Python knows 15.1 or 16)."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for low, high in ranges:
            out[low : high + 1] = kind
    out[list(WHITE)] = BLANK
    return out


def piece_starts(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Indexes of the code points at which a piece begins; offsets are those of the texts."""
    n = len(points)
    kind = classes[points]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    blank = kind == BLANK
    start = fresh[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last blank before other signs stands alone, or joins them if it is a plain space.
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~fresh[1:-1]
    start |= last
    joins = last & (points == 32)
    start[1:] &= ~joins[:-1] | fresh[1:-1]
    # An apostrophe that begins a piece takes a known ending along.
    tick = np.flatnonzero((points == 39) & start)
    padded = np.concatenate((points, np.zeros(2, points.dtype)))
    row_end = offsets[np.searchsorted(offsets, tick, "right")] if len(tick) else tick
    open_ = np.ones(len(tick), bool)
    for ending in ENDINGS:
        hit = open_ & (tick + len(ending) < row_end)
        for k, c in enumerate(ending):
            hit &= padded[np.minimum(tick + 1 + k, n)] == ord(c)
        open_ &= ~hit
        at = tick[hit]
        start[at + 1] = False
        after = at + 1 + len(ending)
        after = after[after < n]
        # A plain space behind it begins its own piece already; all others begin one here.
        start[after] = True
    return np.flatnonzero(start)


class _Ragged:
    """Byte strings by number, for joining many of them in one numpy step."""

    def __init__(self, lines: list[bytes]):
        self.data = np.frombuffer(b"".join(lines), np.uint8)
        self.size = np.array([len(x) for x in lines], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def join(self, numbers: np.ndarray, bounds: np.ndarray) -> Iterator[memoryview]:
        """The strings of each text's numbers in a row. Texts are joined a few at a time, since the indexes
        of their bytes take many times their room."""
        ends = np.concatenate(([0], np.cumsum(self.size[numbers])))[bounds]
        for low, high in slices(ends, JOINED):
            part = numbers[bounds[low] : bounds[high]]
            joined = memoryview(gather(self.data, self.at[part], self.size[part]))
            at = (ends[low : high + 1] - ends[low]).tolist()
            yield from (joined[a:b] for a, b in zip(at, at[1:]))


class Ranks:
    """A rank file, with a hash table from pairs of ids to the id of the joined token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.rank.values()) + 1
        self.token: list[bytes] = [b""] * size
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.bytes_of = _Ragged(self.token)
        self.decimal_of = _Ragged([b"%d," % k for k in range(size)])
        keys, values = [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.pair = dict(zip(keys, values))
        self._hash(np.array(keys, np.uint64), np.array(values, np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing at a load of at most a quarter."""
        self.bits = int(4 * len(keys)).bit_length()
        self.none = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.keys = np.full(1 << self.bits, self.none)
        self.values = np.full(1 << self.bits, NEVER)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == self.none)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair; the largest integer where the pair is unknown."""
        keys = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).ravel()
        slot = self._slot(keys)
        there = self.keys[slot]
        out = self.values[slot]
        todo = np.flatnonzero((there != keys) & (there != self.none))
        out[there == self.none] = NEVER
        at = slot[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.keys[at]
            out[todo] = self.values[at]
            more = (there != keys[todo]) & (there != self.none)
            todo, at = todo[more], at[more]
        return out.reshape(left.shape)


def merge_matrix(ids: np.ndarray, length: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of a padded matrix to its end; returns the matrix and the new lengths."""
    out, final = ids.copy(), length.copy()
    row = np.arange(len(ids))
    pairs = ranks.ranks_of(ids[:, :-1], ids[:, 1:])
    pairs[np.arange(ids.shape[1] - 1) >= (length - 1)[:, None]] = NEVER
    while len(row):
        at = pairs.argmin(axis=1)
        lines = np.arange(len(row))
        best = pairs[lines, at]
        over = best == NEVER
        if over.any():
            out[row[over], : ids.shape[1]] = ids[over]
            final[row[over]] = length[over]
            go = ~over
            row, ids, length, pairs, at, best = row[go], ids[go], length[go], pairs[go], at[go], best[go]
            lines = np.arange(len(row))
            if not len(row):
                break
        width = ids.shape[1]
        # Compaction: all that stands behind the merged pair moves one to the left.
        ids[lines, at] = best
        columns = np.arange(width - 1)
        shift = columns + (columns > at[:, None])
        ids = np.take_along_axis(ids, shift, axis=1)
        length = length - 1
        pairs = np.concatenate((pairs, np.full((len(row), 1), NEVER)), axis=1)
        pairs = np.take_along_axis(pairs, (shift + (shift == at[:, None]))[:, : width - 2], axis=1)
        for side in (at - 1, at):
            ok = (side >= 0) & (side < length - 1)
            r, c = lines[ok], side[ok]
            pairs[r, c] = ranks.ranks_of(ids[r, c], ids[r, c + 1])
        if width == 2:
            out[row, 0], final[row] = ids[:, 0], 1
            break
    return out, final


def merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """The same merges for one long piece, by a heap of pairs over a linked list."""
    ids = [int(ranks.byte[b]) for b in piece]
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1)
            if (r := ranks.pair.get(ids[k] << 32 | ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, a, b = heapq.heappop(heap)
        j = right[k]
        if ids[k] != a or j >= n or ids[j] != b:
            continue
        ids[k], ids[j] = rank, -1
        right[k] = right[j]
        if right[j] < n:
            left[right[j]] = k
        for p in (left[k], k):
            if p >= 0 and right[p] < n:
                r = ranks.pair.get(ids[p] << 32 | ids[right[p]])
                if r is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[right[p]]))
    return [i for i in ids if i >= 0]


def encode_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each span of bytes, one after the other, and their counts: the span itself if it is
    a token, else by rows of like length."""
    raw, length = data.tobytes(), end - start
    whole = np.fromiter((ranks.rank.get(raw[a:b], -1) for a, b in zip(start.tolist(), end.tolist())), np.int64, len(start))
    count = np.ones(len(start), np.int64)
    parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype(np.int32))]
    width = np.where(length <= 32, (length + 3) // 4 * 4, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
    width[(whole >= 0) | (length > LONG)] = 0
    for w in np.unique(width[width > 0]).tolist():
        members = np.flatnonzero(width == w)
        for low in range(0, len(members), max(1, MATRIX_CELLS // w)):
            part = members[low : low + max(1, MATRIX_CELLS // w)]
            inside = np.arange(w) < length[part, None]
            matrix = np.zeros((len(part), w), np.int32)
            matrix[inside] = ranks.byte[gather(data, start[part], length[part])]
            ids, count[part] = merge_matrix(matrix, length[part], ranks)
            parts.append((part, ids[np.arange(w) < count[part, None]]))
    for k in np.flatnonzero((whole < 0) & (length > LONG)).tolist():
        ids = merge_long(raw[start[k] : end[k]], ranks)
        count[k] = len(ids)
        parts.append((np.array([k]), np.array(ids, np.int32)))
    at, out = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int32)
    for part, ids in parts:
        size = count[part]
        out[np.repeat(at[part] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
    return out, count


class Encoder:
    """Texts to ids, with the pieces seen so far kept in the worker process."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}  # a piece -> its line below
        self.bytes = 0
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        end = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        start = np.concatenate(([0], end))[:-1]
        ids, count = encode_spans(np.frombuffer(b"".join(pieces), np.uint8), start, end, self.ranks)
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces))))
        self.bytes += int(end[-1]) if len(end) else 0
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, ids))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice of texts, one after the other, and n + 1 offsets into them."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        lead = (data & 0xC0) != 0x80
        byte_of = np.concatenate((np.flatnonzero(lead), [len(data)]))
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        rows = np.searchsorted(byte_of, offsets)
        first = piece_starts(points, rows, self.classes)
        start = byte_of[first]
        end = np.append(start[1:], len(data))
        coded = strings(data, start, end).dictionary_encode()
        known = coded.dictionary.to_pylist()
        if len(self.number) > CACHE_PIECES or self.bytes > CACHE_BYTES:
            self.forget()
        self._learn([piece for piece in known if piece not in self.number])
        number = np.fromiter(map(self.number.__getitem__, known), np.int64, len(known))[coded.indices.to_numpy()]
        ids = gather(self.flat, self.at[number], self.count[number])
        per_piece = np.concatenate(([0], np.cumsum(self.count[number])))
        return ids, per_piece[np.searchsorted(first, rows)]


def encoder(path: str) -> Encoder:
    return per_process(f"bpe {path}", lambda: Encoder(path))


def decode(ids: list[int], ranks: Ranks) -> bytes:
    return b"".join(map(ranks.token.__getitem__, ids))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of its whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets, SLICE):
                ids, at = coder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))],
                    ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id bigint, ids array<int>")


def encoding_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids, a digest of the ids, and a digest of their decoding."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets, SLICE):
                ids, at = coder.encode(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                numbers = [hashlib.sha256(x[:-1]).hexdigest() for x in coder.ranks.decimal_of.join(ids, at)]
                texts = [hashlib.sha256(x).hexdigest() for x in coder.ranks.bytes_of.join(ids, at)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(np.diff(at), pa.int64()),
                     pa.array(numbers, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
