"""Benchmark decontamination on templates, to catch copied and re-parameterised questions.

Words lose outer punctuation and case. Numbers (also written-out ones), capitalised words and units
after numbers become typed placeholders; what stood there is a slot value. Windows of five
template words of the benchmark and of the documents are joined by hash, and beside them windows in
which names stay words: case tells names, so a copy in lower or upper case has other ones. A window of nothing but
placeholders says little and may stand in very many texts; where an item has others, it is met by its own words
instead. Places are joined by cells of ``DRIFT`` words, so long runs of like windows meet once a cell.
A passage of a document is a candidate if it shares a window with an item (so copies without five words
in a row between two edits are not met). Candidates are decided on the texts: item and passage are
aligned word by word, 80 % of the item's words must stand in line, and the slots of this alignment agree: each slot value of the
item always becomes the same value of the document (``SLOTS`` of the distinct values at least). Equal
windows at other shifts, as in runs of names or numbers, contradict nothing. ``VERBATIM`` equal words of
an item in a row are a leak of their own. The alignment is looked for in a band: parts of an item that lie more than
``BAND`` words off the rest aren't lined up with it, and memory grows with the item's words, not with their square.

Items of one template and one slot pattern form a class, named by the smallest item_id, so a family of
like questions is met once. Before the join a bitmap of fixed size drops document windows that no
item has; its size does not depend on the benchmark, only its sharpness does.

Null and empty texts, and items of fewer than five words, have no windows and match nothing. Rows are
told apart by doc_id and text, so repeated rows give one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloom.llm.arrays import (
    byte_codes, find_words, flat, list_array, mix, signed, slices, span_hashes, windows,
)
from workloom.llm.bitmap import Bitmap
from workloom.llm.shared import kept

WINDOW = 5
#: Share of an item's words that must stand in line.
COVERAGE = 0.8
#: So many equal words of an item in a row are a leak, whatever their share.
VERBATIM = 30
SLOTS = 0.8
#: Alignments (document place less item place) up to this far apart belong to one passage.
DRIFT = 16
BAND = 256
#: Items that are compared with one copy of a text, about.
CHUNK = 32

#: Words that stand for numbers, and units.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()
UNIT_WORDS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
    "pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees "
    "kmh mph km/h m/s"
).split()

_WORDY = ((np.arange(256) >= 48) & (np.arange(256) <= 57)) | (
    (np.arange(256) >= 65) & (np.arange(256) <= 90)) | (
    (np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_NUMERIC = _DIGIT | np.isin(np.arange(256), [ord(c) for c in ".,:/-"])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)

NAME, NUMBER, UNIT = (np.uint64(x) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0676A9A99))


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(words, pa.string()))
    return np.sort(span_hashes(data, offsets[:-1], offsets[1:], byte_codes(fold_case=True)))


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _trimmed(data: np.ndarray, offsets: np.ndarray):
    """Words without outer punctuation: start, end, first-word bounds of each row."""
    words = find_words(data, offsets)
    start, end = words.start.copy(), words.end.copy()
    while len(start):  # one sign a turn
        cut = (start < end - 1) & ~_WORDY[data[start]]
        if not cut.any():
            break
        start[cut] += 1
    while len(start):
        cut = (start < end - 1) & ~_WORDY[data[end - 1]]
        if not cut.any():
            break
        end[cut] -= 1
    return start, end, words.first


def canonical(raw: tuple[np.ndarray, np.ndarray], lower: tuple[np.ndarray, np.ndarray]):
    """Word hash, template hash, first-word bounds of each row of a slice, given as bytes and offsets,
    and once more in lower case (which leaves the places of the words)."""
    data, offsets = lower
    start, end, first = _trimmed(data, offsets)
    hashes = span_hashes(data, start, end, byte_codes(fold_case=True))
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    numeric = np.concatenate(([0], np.cumsum(_NUMERIC[data])))
    is_number = (digits[end] > digits[start]) & (numeric[end] - numeric[start] == end - start)
    is_number |= _among(hashes, _hashes(NUMBER_WORDS))
    follows = np.concatenate(([False], is_number[:-1]))[: len(start)] & ~np.isin(np.arange(len(start)), first)
    is_unit = follows & ~is_number & _among(hashes, _hashes(UNIT_WORDS))
    upper = _UPPER[raw[0][_trimmed(*raw)[0]]] if len(start) else np.zeros(0, bool)
    is_name = ~is_number & ~is_unit & upper
    template = np.where(is_number, NUMBER, np.where(is_unit, UNIT, np.where(is_name, NAME, hashes)))
    return hashes, template, first


def _placeholder(template: np.ndarray) -> np.ndarray:
    return (template == NAME) | (template == NUMBER) | (template == UNIT)


def _windows(word: np.ndarray, template: np.ndarray, first: np.ndarray):
    """Hashes of all windows with names as placeholders, with names as words, and of the words as they are; which
    windows are nothing but placeholders; and the first word of each."""
    h, at = windows(template, first, WINDOW)
    plain, _ = windows(np.where(template == NAME, word, template), first, WINDOW)
    own, _ = windows(word, first, WINDOW)
    total = np.concatenate(([0], np.cumsum(_placeholder(template))))
    return h, plain, own, total[at + WINDOW] - total[at] == WINDOW, at


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple, tuple]]:
    """Row ranges of a batch with their texts, and these in lower case."""
    both = flat(batch.column("text")), flat(batch.column("lower"))
    for low, high in slices(both[0][1]):
        yield low, high, *((d[o[low] : o[high]], o[low : high + 1] - o[low]) for d, o in both)


def _key(run: np.ndarray, pattern: np.ndarray) -> int:
    x = mix(run * np.uint64(3) + pattern) * (2 * np.arange(len(run), dtype=np.uint64) + np.uint64(1))
    return int(signed(mix(x.sum(keepdims=True, dtype=np.uint64) + np.uint64(len(run))))[0])


def template_items(benchmark: DataFrame) -> DataFrame:
    """Per variant of a class of items: item_id (the smallest), n_items, and its words, templates and windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, lower in _slices(batch):
                word, template, first = canonical(raw, lower)
                h, plain, raw_h, blank, at = _windows(word, template, first)
                row = np.searchsorted(first, at, "right") - 1
                blank &= (np.bincount(row[~blank], minlength=high - low) > 0)[row]  # others tell more
                plain = np.where(blank & (plain == h), raw_h, plain)
                h = np.where(blank, raw_h, h)
                keys, variants = [], []
                for k in range(high - low):
                    run, own = template[first[k] : first[k + 1]], word[first[k] : first[k + 1]]
                    # Number the slot values by their first use: equal patterns, equal keys.
                    _, where, inverse = np.unique(
                        np.where(_placeholder(run), own | np.uint64(1), np.uint64(0)), return_index=True, return_inverse=True)
                    keys.append(_key(run, where[inverse].astype(np.uint64)))
                    variants.append(_key(np.where(run == NAME, own, run), np.full(len(run), keys[-1], np.int64).view(np.uint64)))
                sizes = np.diff(first)
                n_windows = np.maximum(sizes - WINDOW + 1, 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column("item_id").slice(low, high - low), pa.array(keys, pa.int64()), pa.array(variants, pa.int64()),
                    list_array(signed(word), sizes, pa.int64()), list_array(signed(template), sizes, pa.int64()),
                    list_array(signed(h), n_windows, pa.int64()), list_array(signed(plain), n_windows, pa.int64()),
                ], ["item_id", "template", "variant", "words", "templates", "named", "plain"])

    rows = kept(benchmark.select("item_id", "text", F.lower("text").alias("lower")).mapInArrow(
        work, "item_id bigint, template bigint, variant bigint, words array<bigint>, templates array<bigint>, "
              "named array<bigint>, plain array<bigint>",
    ).filter(F.size("named") > 0), "items")
    classes = rows.groupBy("template").agg(
        F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    # Items of a class that differ in names are its variants; placeholders are met with the one that
    # names the class only.
    variants = rows.groupBy("template", "variant").agg(
        F.min("item_id").alias("least"), F.min_by(F.struct("words", "templates", "named", "plain"), "item_id").alias("x"))
    return variants.join(classes, "template").select(
        "variant", "item_id", "n_items", (F.col("least") == F.col("item_id")).alias("leads"), "x.*")


def document_windows(docs: DataFrame, known: Bitmap) -> DataFrame:
    """Windows of documents that pass the bitmap, once for each cell of places: doc_id, text hash, cell, h."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, raw, lower in _slices(batch):
                word, template, first = canonical(raw, lower)
                h, plain, own, blank, at = _windows(word, template, first)
                other, blank = np.flatnonzero(plain != h), np.flatnonzero(blank)
                h, at = np.concatenate((h, plain[other], own[blank])), np.concatenate((at, at[other], at[blank]))
                hit = known.has(h)
                if hit.any():
                    h, at = h[hit], at[hit]
                    row = np.searchsorted(first, at, "right") - 1
                    cell = (at - first[row]) // DRIFT
                    order = np.lexsort((h, cell, row))
                    row, cell, h = row[order], cell[order], h[order]
                    new = np.concatenate(([True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]) | (h[1:] != h[:-1])))
                    take = pa.array(row[new] + low, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(take), batch.column("th").take(take),
                        pa.array(cell[new], pa.int64()), pa.array(signed(h[new]), pa.int64()),
                    ], ["doc_id", "th", "cell", "h"])

    return docs.select("doc_id", "text", F.lower("text").alias("lower"), F.xxhash64("text").alias("th")).mapInArrow(
        work, "doc_id bigint, th bigint, cell bigint, h bigint")


def texts_of(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(th, text, lower): each candidate text once; the others are dropped before the shuffle."""
    known = Bitmap.of(candidates, "th")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.has(batch.column("th").to_numpy(zero_copy_only=False))))

    return docs.select(F.xxhash64("text").alias("th"), "text").mapInArrow(work, "th bigint, text string").dropDuplicates(
        ["th"]).select("th", "text", F.lower("text").alias("lower"))


def align(match: np.ndarray, same: np.ndarray, main: slice) -> tuple[np.ndarray, np.ndarray]:
    """Item places and document places that stand in line: as many as can, by preference equal words.
    A row is an item word, a column how far the document word lies from it; ``main`` are the columns of
    the alignments looked for. A matching word may lie up to ten document words off the rest, a longer
    part farther."""
    n, wide = match.shape
    hits = match[:, main].sum(axis=0)
    best = int((hits * (n + 1) + same[:, main].sum(axis=0)).argmax())
    if hits[best] == n:
        return np.arange(n), np.arange(n) + main.start + best
    step = np.arange(wide) * 100
    gain = np.where(match, 1000 + same, -1).astype(np.int64)
    scores = np.zeros((n + 1, wide), np.int64)
    for i in range(n):
        row = scores[i] + gain[i]
        row[:-1] = np.maximum(row[:-1], scores[i, 1:] - 1)  # the item's word has no partner
        scores[i + 1] = np.maximum.accumulate(row + step) - step  # nor have the document's
    i, k = n, int(scores[n].argmax())
    pairs = []
    while i:
        if scores[i, k] == scores[i - 1, k] + gain[i - 1, k]:
            i -= 1
            if match[i, k]:
                pairs.append((i, i + k))
        elif k + 1 < wide and scores[i, k] == scores[i - 1, k + 1] - 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
    out = np.array(pairs[::-1], np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def verbatim(same: np.ndarray) -> bool:
    """Whether VERBATIM words of the item stand in the document in a row."""
    if len(same) < VERBATIM:
        return False
    total = np.cumsum(same, axis=0, dtype=np.int32)
    return bool((total[VERBATIM - 1] == VERBATIM).any() or (total[VERBATIM:] - total[:-VERBATIM] == VERBATIM).any())


def held(item: tuple[np.ndarray, np.ndarray], doc: tuple[np.ndarray, np.ndarray], grid: int):
    """Whether a text holds an item near one alignment, given both as words and templates: None, or the
    share of the item's words that stand in line, and whether all slots are equal."""
    (iw, it), n = item, len(item[0])
    half, wide = min(n, BAND), 4 * DRIFT
    low = (grid - 2) * DRIFT
    places = np.arange(low - half, low + wide + n + half)
    inside = (places >= max(low, 0)) & (places < min(low + wide + n, len(doc[0])))
    dw, dt = (np.where(inside, x[np.clip(places, 0, len(x) - 1)], np.uint64(0)) for x in doc)
    slot = _placeholder(it)
    need = COVERAGE * n
    if (np.isin(iw, dw) | slot & np.isin(it, dt)).sum() < min(need, VERBATIM):
        return None
    near = lambda x: np.lib.stride_tricks.sliding_window_view(x, wide + 2 * half + 1)
    same = iw[:, None] == near(dw)
    match = same | (slot[:, None] & (it[:, None] == near(dt)))
    main = slice(half, half + wide + 1)
    i, j = align(match, same, main)
    at = slot[i]
    pairs = set(zip(iw[i[at]].tolist(), dw[j[at]].tolist()))
    if (len(i) < need or len({x for x, _ in pairs}) < SLOTS * len(pairs)) and not verbatim(same[:, main]):
        return None
    return len(i) / n, all(x == y for x, y in pairs)


def verified(candidates: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """(th, item_id, n_items, coverage, exact) of the candidates (th, variant, grids) that hold. The items of
    a text come in parts of about CHUNK, each with its own copy of the text."""
    parts = candidates.groupBy("th").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    split = candidates.join(parts, "th").withColumn("part", F.pmod(F.xxhash64("variant"), "parts"))
    by_text = split.join(items.select("variant", "item_id", "n_items", "leads", "words", "templates"), "variant").groupBy("th", "part").agg(
        F.collect_list(F.struct("item_id", "n_items", "leads", "words", "templates", "grids")).alias("items"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["th", "item_id", "n_items", "coverage", "exact"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        unsigned = lambda x: np.array(x, np.int64).view(np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for low, high, raw, lower in _slices(batch):
                word, template, first = canonical(raw, lower)
                for k in range(low, high):
                    run = slice(first[k - low], first[k - low + 1])
                    for x in batch.column("items")[k].as_py():
                        item = unsigned(x["words"]), unsigned(x["templates"])
                        for grid in x["grids"]:
                            got = held(item, (word[run], template[run]), grid)
                            if got:
                                out.append((batch.column("th")[k].as_py(), x["item_id"], x["n_items"], got[0], got[1] and x["leads"]))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    rows = texts.join(by_text, "th").select("th", "text", "lower", "items").mapInArrow(
        work, "th bigint, item_id bigint, n_items bigint, coverage double, exact boolean")
    return rows.groupBy("th", "item_id", "n_items").agg(F.max("coverage").alias("coverage"), F.max("exact").alias("exact"))


def near_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, th, variant, grid): documents and items that share a window, by cells of their distance."""
    places = items.select("variant", "leads", F.posexplode(
        F.arrays_zip("named", "plain")).alias("place", "x"))
    hashes = F.when(F.col("leads"), F.array_distinct(F.array("x.named", "x.plain"))).when(
        F.col("x.named") != F.col("x.plain"), F.array("x.plain"))
    places = places.select("variant", F.floor(F.col("place") / DRIFT).alias("from"), F.explode(hashes).alias("h")).distinct()
    found = document_windows(docs, Bitmap.of(places, "h")).join(places, "h")
    return found.select("doc_id", "th", "variant", (F.col("cell") - F.col("from")).alias("grid")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item class: doc_id, th, item_id, n_items, coverage, and
    exact (all slots are those of the item that names the class)."""
    items = kept(template_items(benchmark), "item-classes")
    # One window makes a candidate; the words decide.
    near = kept(near_items(docs, items), "candidates")
    candidates = near.groupBy("th", "variant").agg(F.collect_set("grid").alias("grids"))
    return verified(candidates, texts_of(docs, near), items).join(near.select("doc_id", "th").distinct(), "th").select(
        "doc_id", "th", "item_id", "n_items", "coverage", "exact")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents with the classes of items they hold."""
    return leaks(docs, benchmark).drop("th")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("__leak_id"), F.col("th").alias("__leak_th")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("__leak_id")) & (F.xxhash64("text") == F.col("__leak_th"))
    return docs.join(bad, on, "left_anti")
