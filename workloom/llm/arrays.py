"""Texts of an Arrow batch as flat numpy arrays: bytes, words, word hashes, shingle sets.

All steps are vectorised over a slice of rows of about ``SLICE_BYTES``, so memory follows the
slice, or one text where a single text is longer.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def per_process(key: str, build: Callable[[], object]) -> object:
    """A value built once per Python process, although the code arrives anew with each task."""
    kept = sys.__dict__.setdefault("_workloom_llm_kept", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, at * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    kept = per_process("powers", dict)
    if kept.get("n", 0) < n:
        size = max(n, SLICE_BYTES + 1)
        kept.update(n=size, up=_powers(BASE, size), down=_powers(BASE_INVERSE, size))
    return kept["up"], kept["down"]


def byte_codes(fold_case: bool) -> np.ndarray:
    """A random 64-bit code per byte; with fold_case A-Z have the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


#: Spans are hashed modulo a prime: modulo a power of two, regular texts of one length share hashes.
PRIME = np.uint64((1 << 31) - 1)
PRIME_BASES = (0x3C6EF372, 0x1B873593)


def _fold(x: np.ndarray) -> np.ndarray:
    """Less than 2**33, and equal to x modulo PRIME."""
    return (x & PRIME) + (x >> np.uint64(31))


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, int(PRIME))) % PRIME
        done += more
    return out


def prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both bases the powers of the base and of its inverse, at least n of each."""
    kept = per_process("prime powers", dict)
    if kept.get("n", 0) < n:
        size = max(n, SLICE_BYTES + 1)
        kept.update(n=size, powers=[tuple(_prime_powers(b, size) for b in (base, pow(base, -1, int(PRIME)))) for base in PRIME_BASES])
    return kept["powers"]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, of 62 bits under two bases, from two running sums over the slice."""
    out = (end - start).astype(np.uint64)
    for k, (up, down) in enumerate(prime_powers(len(data) + 1)):
        total = np.zeros(len(data) + 1, np.uint64)
        own = (codes >> np.uint64(33 * k)) & PRIME
        np.cumsum(_fold(own[data] * up[: len(data)]), out=total[1:])  # below 2**63 for 2**30 bytes
        value = _fold(_fold(_fold(total[end] - total[start]))) % PRIME * down[start] % PRIME
        out = mix(out + value + np.uint64(k))
    return out


class Words(NamedTuple):
    start: np.ndarray  # first byte
    end: np.ndarray  # byte after the last
    doc: np.ndarray  # row of the slice
    first: np.ndarray  # index of each row's first word, n + 1 entries


#: Bytes 9 to 13 and the blank separate words.
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: All but digits, letters and bytes of characters beyond ASCII separate words.
SIGNS = ~(
    ((np.arange(256) >= 48) & (np.arange(256) <= 57))
    | ((np.arange(256) >= 65) & (np.arange(256) <= 90))
    | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
    | (np.arange(256) >= 128)
)


def find_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = BLANKS) -> Words:
    """Maximal runs of bytes that are not separators; a run never crosses rows."""
    n = len(offsets) - 1
    inside = ~separators[data]
    fresh = np.zeros(len(data) + 1, bool)  # a row begins here
    fresh[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | fresh[:-1])) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    first = np.searchsorted(start, offsets)
    return Words(start, end, np.repeat(np.arange(n), np.diff(first)), first)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width`` consecutive words of a row, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += mix(hashes[k : k + n] + np.uint64(k + 1)) * np.uint64(2 * k + 0x2545F4914F6CDD1D)
    row_end = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + width <= row_end[:n])
    return mix(total[at]), at


def gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[start : start + count] of every entry, one after the other."""
    total = int(count.sum())
    base = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return values[base + np.arange(total)]


SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def small_letters(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return SMALL[data]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of each span, as a binary column."""
    bounds = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(gather(data, start, end - start))])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
