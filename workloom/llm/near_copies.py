"""Near-duplicate documents: bottom-k sketches from one hash function, inverted lists of retained
values, union-sketch estimates, and exact Jaccard on full sets.

A document is the set of 64-bit hashes of its distinct shingles of ``width`` words (with fewer words, its
whole sequence); equal sets form a class, and all further work is on classes. A class keeps its K smallest
hashes. Sets of similarity 0.8 share at least 20 of 48 retained values but for a chance below 1e-8; a
set of fewer than K hashes shares three quarters of them for certain. Therefore two such sketches meet
MEET times among their first (size - shared + MEET) values in any common order; with the rarest first,
lists stay short, and values that no other class of a fitting size has need no list: no similar class shares them.

In each list and band of sizes the class with the fewest values of its own is the centre; every member
is compared with what is the centre of CENTRE of its lists, and what is confirmed forms components. Components, and
classes with their most similar centres, form families. What is left is compared in two ways:

* inside a family, members outside its largest component against all members, in blocks of BLOCK sets
  that are intersected in numpy; only links between a member and a component are written out;
* across families, classes of different components that meet in one of the first (size - shared + 1) lists;
  lists of fewer than HOT members, without those whom no other fits by size, are taken many to a task, longer
  ones in blocks of members. Both compare
  sketches on the spot, and only pairs that may hold leave.

So every pair that meets is compared or already connected. A hot group of near copies costs a
comparison per member and list, and one block product per BLOCK members that its centre misses.

A pair is confirmed on the full sets: 100 * intersection >= 80 * union. The estimate from the union
sketch goes first and drops pairs below ``ESTIMATE`` (six standard deviations under 0.8).

Null and empty texts have no shingles and are linked with nothing; their component is themselves.
Repeated rows belong to one class and get equal results. Rows without a doc_id take part; they do
not give their component a name, and where no row with an id is in it, its smallest class stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from workloom.llm.arrays import (
    byte_codes, find_words, flat, gather, list_array, mix, signed, slices, span_hashes, windows,
)
from workloom.llm.bitmap import Bitmap
from workloom.llm.components import components
from workloom.llm.shared import kept

K = 48
SHARED = 20
MEET = 6
ESTIMATE = 0.8 - 6 * (0.8 * 0.2 / K) ** 0.5
BLOCK = 512
HOT = 64
CENTRE = 3
#: Steps of size that lie between fitting sizes at most; a step is a bit of 64, steps of one bit are apart by a factor of 35.
REACH = 4
#: Rows of short lists in a task's group, and values of the codes that stand for retained values there.
LIST_ROWS, CODES = 20_000, 1024
#: Words of a shingle: of the contract's query, and where one document of each group is kept.
SHINGLE, STAGE_SHINGLE = 2, 5
PERCENT = 80


def shingle_sets(part: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a slice, as signed integers."""
    words = find_words(part, offsets)
    hashes = span_hashes(part, words.start, words.end, byte_codes(fold_case=True))
    shingles, at = windows(hashes, words.first, width)
    bounds = np.searchsorted(at, words.first)
    counts = np.diff(words.first)
    out = []
    for row in range(len(offsets) - 1):
        if counts[row] >= width:
            out.append(np.unique(signed(shingles[bounds[row] : bounds[row + 1]])))
        else:
            run = hashes[words.first[row] : words.first[row + 1]]
            whole = np.zeros(1, np.uint64)
            for k, h in enumerate(run):
                whole += mix(np.array([h]) + np.uint64(k + 1)) * np.uint64(2 * k + 0x9E3779B97F4A7C15)
            out.append(signed(mix(whole + np.uint64(len(run))))[: len(run) and 1])
    return out


def fingerprint(values: np.ndarray) -> bytes | None:
    """16 bytes that stand for a set."""
    if not len(values):
        return None
    x = values.view(np.uint64)
    two = [int(mix(x ^ np.uint64(salt)).sum(dtype=np.uint64)) for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    return two[0].to_bytes(8, "big") + (two[1] ^ len(values)).to_bytes(8, "big")


def sketches(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """doc_id, text hash, the set's fingerprint (key, null without words), set size, and the k smallest hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets):
                sets = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)
                heads = [s[:k] for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low), batch.column("th").slice(low, high - low),
                    pa.array([fingerprint(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    list_array(np.concatenate(heads), np.array([len(s) for s in heads]), pa.int64()),
                ], ["doc_id", "th", "key", "n", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        work, "doc_id bigint, th bigint, key binary, n bigint, sketch array<bigint>")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per distinct set: key, n, sketch, the smallest doc_id, the hash of one of its texts, and a number
    (cid) that stands for the set once the frame is written: joins carry half as many bytes as with keys."""
    return rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.min("th").alias("th"),
        F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("cid", F.monotonically_increasing_id())


def _shared(size: Column) -> Column:
    """Retained values that two similar sketches have in common at least."""
    return F.when(size < K, F.ceil(size * 0.75)).otherwise(SHARED).cast("int")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """(v, cid, n, common, first): the rarest retained values of every class, enough for similar ones to meet
    MEET times, once among those marked ``first``; ``common`` is the share of its values that other classes of
    a fitting size have. Values that none of these has are shared with no similar class and need no list."""
    step = F.floor(F.log(F.col("n").cast("double")) * (REACH / math.log(100 / PERCENT)))
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    bit = F.expr("shiftleft(1L, CAST(step & 63 AS INT))")
    steps = classes.select(step.alias("step"), F.explode("sketch").alias("v")).select("v", bit.alias("bit"))
    often = steps.groupBy("v").agg(
        F.count("*").alias("df"), F.bit_or("bit").alias("seen"), F.bit_xor("bit").alias("odd")).filter("df > 1")
    # Exactly one class has a step if the odd ones hold one and the even ones two each; else it may be several.
    plain = F.col("df") == 2 * F.bit_count("seen") - F.bit_count("odd")
    often = often.select("v", "df", "seen", F.when(plain, F.col("odd")).otherwise(F.lit(0)).alias("once")).filter(
        F.col("seen").bitwiseAND(_around("seen")).bitwiseOR(F.col("seen").bitwiseAND(F.bitwise_not("once"))) != 0)
    own = values.withColumn("step", step).select("cid", "n", "v", bit.alias("bit"))
    partner = F.col("seen").bitwiseAND(_around("bit")).bitwiseOR(F.col("bit").bitwiseAND(F.bitwise_not("once"))) != 0
    frequent = own.join(often, "v").filter(partner).groupBy("cid", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("list"))  # at most k entries
    size = F.least(F.col("n"), F.lit(K))
    need = _shared(size)
    once = F.size("list") - need + 1
    take = once - 1 + F.least(F.lit(MEET), need)
    return frequent.filter(take > 0).select(
        F.posexplode(F.slice("list", F.lit(1), take.cast("int"))).alias("at", "x"), "cid", "n",
        F.floor(F.size("list") * 1000 / size).alias("common"), once.alias("once"),
    ).select("x.v", "cid", "n", "common", (F.col("at") < F.col("once")).alias("first"))


def _around(bits: str) -> Column:
    """The bits up to REACH places beside those that are set, round the end of the 64."""
    turned = [f"shiftleft({bits}, {k}) | shiftrightunsigned({bits}, {64 - k}) | shiftrightunsigned({bits}, {k}) | shiftleft({bits}, {64 - k})"
              for k in range(1, REACH + 1)]
    return F.expr(" | ".join(turned))


def _fit(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def star_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): every class and the centres of CENTRE or more of its lists, in its own and the next bands
    of sizes. Similar classes that no centre brings together are compared later."""
    banded = lists.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))))
    centres = banded.groupBy("v", "band").agg(F.max(F.struct("common", "cid", "n")).alias("c")).select(
        "v", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), "c")
    pairs = banded.join(centres, ["v", "band"]).filter(_fit("n", "c.n") & (F.col("cid") != F.col("c.cid")))
    return pairs.groupBy(F.col("cid").alias("a"), F.col("c.cid").alias("b")).agg(F.count("*").alias("lists")).filter(
        F.col("lists") >= CENTRE).select("a", "b")


def likely(pairs: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """(a, b, share) of the pairs whose union sketch does not rule them out."""
    own = classes.select("cid", "sketch")
    both = pairs.join(own.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a").join(
        own.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    held = both.select("a", "b", union.alias("u"), F.array_intersect("sa", "sb").alias("i"))
    share = F.size(F.array_intersect("u", "i")) / F.size("u")
    return held.select("a", "b", share.alias("share")).filter(F.col("share") >= ESTIMATE)


def families(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """(cid, root, fam) of all classes in ``stars``: root by confirmed links, fam by roots and each
    class's most similar centre."""
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
    own = stars.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    fams = _roots(_edges(roots).unionByName(best)).select(F.col("u").alias("f"), F.col("root").alias("fam"))
    return own.join(roots, F.col("cid") == F.col("u"), "left").join(fams, F.col("cid") == F.col("f"), "left").select(
        "cid", F.coalesce("root", "cid").alias("root"), F.coalesce("fam", "cid").alias("fam"))


def links_in_families(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links of members outside a family's largest component with any member, by blocks: (a, b), where
    b is the root of the member that a is like. One link per root is enough, and a hot family gets no row per pair."""
    parts = placed.groupBy("fam", "root").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("fam").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("m"), F.max("n").alias("top"),
    ).filter("m > top").select(
        "fam", "main", F.ceil((F.col("m") - F.col("top")) / BLOCK).cast("int").alias("ni"),
        F.ceil(F.col("m") / BLOCK).cast("int").alias("nj"))
    stray = F.col("root") != F.col("main")
    rows = placed.join(sizes, "fam").join(sets, "cid")
    place = F.xxhash64("cid")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asking = rows.filter(stray).select(
        "fam", F.pmod(place, "ni").cast("int").alias("i"), F.explode(numbers("nj")).alias("j"),
        F.lit(True).alias("asks"), "cid", "root", "hashes")
    asked = rows.select(
        "fam", F.explode(numbers("ni")).alias("i"), F.pmod(place, "nj").cast("int").alias("j"),
        F.lit(False).alias("asks"), "cid", "root", "hashes")

    def work(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        cids, roots = group.column("cid").to_numpy(), group.column("root").to_numpy()
        lists = group.column("hashes").combine_chunks()
        bounds = lists.offsets.to_numpy()
        _, codes = np.unique(lists.values.to_numpy()[bounds[0] : bounds[-1]], return_inverse=True)
        bounds = bounds - bounds[0]
        size = np.diff(bounds)
        mine = np.zeros(len(codes) and int(codes.max()) + 1, bool)
        others = np.flatnonzero(~asks)
        flat_codes = gather(codes, bounds[:-1][others], size[others])
        starts = np.cumsum(size[others]) - size[others]
        out = [np.empty((2, 0), np.int64)]
        for k in np.flatnonzero(asks).tolist():
            own = codes[bounds[k] : bounds[k + 1]]
            mine[own] = True
            common = np.add.reduceat(mine[flat_codes].astype(np.int64), starts)
            mine[own] = False
            hit = 100 * common >= PERCENT * (size[k] + size[others] - common)
            near = np.unique(roots[others[hit & (roots[others] != roots[k])]])
            out.append(np.stack([np.full(len(near), cids[k]), near]))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": a, "b": b})

    return asking.unionByName(asked).groupBy("fam", "i", "j").applyInArrow(work, "a bigint, b bigint")


def cross_pairs(lists: DataFrame, placed: DataFrame, classes: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of different families and components: lists of fewer than HOT members many to
    a group, those of more members by blocks."""
    at = lists.filter("first").select("v", "cid", "n").join(
        placed.withColumnRenamed("cid", "c"), F.col("cid") == F.col("c"), "left").select(
        "v", "cid", "n", F.coalesce("root", "cid").alias("root"), F.coalesce("fam", "cid").alias("fam"))
    sizes = at.groupBy("v", "fam").agg(F.count("*").alias("m"))
    main = sizes.groupBy("v").agg(
        F.max_by("fam", F.struct("m", "fam")).alias("main"), F.count("*").alias("k"), F.sum("m").alias("size"),
        F.max("m").alias("top")).filter("k > 1").drop("k")
    mixed = kept(_with_partners(at.join(main, "v")), "mixed")
    few = likely(kept(_met(mixed.filter(F.col("size") < HOT), classes).distinct(), "met"), classes).select("a", "b")
    return few.unionByName(_blocked(mixed.filter(F.col("size") >= HOT), classes)).distinct()


def _with_partners(rows: DataFrame) -> DataFrame:
    """Without the rows of short lists that no other member fits by its size: if the next smaller and the
    next larger set don't, none does. Rows of long lists all stay, each by itself, so no window is long."""
    alone = F.when(F.col("size") >= HOT, F.xxhash64("cid"))
    by_size = W.partitionBy("v", alone).orderBy("n")
    fits = (100 * F.lag("n").over(by_size) >= PERCENT * F.col("n")) | (
        100 * F.col("n") >= PERCENT * F.lead("n").over(by_size))
    return rows.withColumn("_fits", fits).filter(F.col("_fits") | (F.col("size") >= HOT)).drop("_fits")


def _met(mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) in lists of fewer than HOT members that may share enough retained values.

    Lists are dealt into groups of about LIST_ROWS rows, whole lists each. Values are compared by codes
    below CODES: equal values have equal codes, so a pair is never missed; the few that meet by chance go in
    ``likely``. No pair is written but those.
    """
    groups = mixed.count() // LIST_ROWS + 1
    code = F.transform("sketch", lambda x: x.bitwiseAND(CODES - 1).cast("smallint"))
    rows = mixed.join(classes.select("cid", code.alias("codes")), "cid").select(
        F.pmod(F.xxhash64("v"), F.lit(groups)).alias("g"), "v", "cid", "n", "root", "fam",
        (F.col("fam") != F.col("main")).alias("stray"), "codes")

    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by("v")
        v, n, stray = (group.column(c).to_numpy() for c in ("v", "n", "stray"))
        cids, roots, fams = (
            group.column(c).to_numpy() for c in ("cid", "root", "fam"))
        lists = group.column("codes").combine_chunks()
        size = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(v)), size)
        codes = np.full((len(v), K), CODES, np.int16)
        codes[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
        has = np.zeros((len(v), CODES + 1), bool)
        has[row, lists.flatten().to_numpy()] = True
        need = np.where(size < K, np.ceil(size * 0.75), SHARED)
        found = [np.empty((0, 2), np.int64)]
        for step in range(1, HOT):
            i = np.flatnonzero(v[:-step] == v[step:])
            if not len(i):
                break
            j = i + step
            fits = (stray[i] | stray[j]) & (roots[i] != roots[j]) & (fams[i] != fams[j])
            fits &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            fits = has[j[:, None], codes[i]].sum(axis=1) >= np.maximum(need[i], need[j])
            a, b = cids[i[fits]], cids[j[fits]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({side: pairs[:, k] for k, side in enumerate("ab")})

    return rows.groupBy("g").applyInArrow(work, "a bigint, b bigint")


def _blocked(mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of long lists that share enough retained values and whose union sketch holds; each
    pair comes from the smallest of its long lists only."""
    own = mixed.groupBy("cid").agg(F.array_sort(F.collect_set("v")).alias("lists"))  # at most K entries
    rows = mixed.join(own, "cid").join(classes.select("cid", "sketch"), "cid").withColumns({
        "ni": F.ceil((F.col("size") - F.col("top")) / BLOCK).cast("int"), "nj": F.ceil(F.col("size") / BLOCK).cast("int")})
    place = F.xxhash64("cid")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = ["v", "i", "j", "asks", "cid", "n", "root", "fam", "stray", "lists", "sketch"]
    marked = rows.withColumn("stray", F.col("fam") != F.col("main"))
    asking = marked.filter("stray").withColumns({
        "i": F.pmod(place, "ni").cast("int"), "j": F.explode(numbers("nj")), "asks": F.lit(True)}).select(columns)
    asked = marked.withColumns({
        "i": F.explode(numbers("ni")), "j": F.pmod(place, "nj").cast("int"), "asks": F.lit(False)}).select(columns)

    def work(group: pa.Table) -> pa.Table:
        v = group.column("v")[0].as_py()
        asks, stray, n = (group.column(c).to_numpy() for c in ("asks", "stray", "n"))
        cids, roots, fams = (group.column(c).to_numpy() for c in ("cid", "root", "fam"))
        sketch = group.column("sketch").combine_chunks()
        bounds = sketch.offsets.to_numpy() - sketch.offsets[0].as_py()
        values = sketch.flatten().to_numpy()
        _, codes = np.unique(values, return_inverse=True)
        size = np.diff(bounds)
        need = np.where(size < K, np.ceil(size * 0.75), SHARED)
        others = np.flatnonzero(~asks)
        flat_codes = gather(codes, bounds[:-1][others], size[others])
        starts = np.cumsum(size[others]) - size[others]
        mine = np.zeros(len(codes) + 1, bool)
        places = group.column("lists")
        out: list[tuple[int, int]] = []
        for k in np.flatnonzero(asks).tolist():
            own_codes = codes[bounds[k] : bounds[k + 1]]
            mine[own_codes] = True
            common = np.add.reduceat(mine[flat_codes].astype(np.int64), starts)
            mine[own_codes] = False
            low, high = np.minimum(n[others], n[k]), np.maximum(n[others], n[k])
            ok = (common >= np.maximum(need[others], need[k])) & (100 * low >= PERCENT * high)
            ok &= (roots[others] != roots[k]) & (fams[others] != fams[k])
            for o in others[ok].tolist():
                if stray[o] and cids[o] <= cids[k]:
                    continue
                a, b = values[bounds[k] : bounds[k + 1]], values[bounds[o] : bounds[o + 1]]
                union = np.union1d(a, b)[:K]
                share = np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean()
                if share >= ESTIMATE and min(set(places[k].as_py()) & set(places[o].as_py())) == v:
                    out.append((min(cids[k], cids[o]), max(cids[k], cids[o])))
        columns = list(zip(*out)) or [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return asking.unionByName(asked).groupBy("v", "i", "j").applyInArrow(work, "a bigint, b bigint")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(cid, hashes) of the wanted classes (cid, key, th), from the texts.

    A bitmap of text hashes, of fixed size, drops the other documents before anything is shuffled;
    where it lets one through, the join on key drops it.
    """
    bits = Bitmap.of(wanted, "th")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bits.has(batch.column("h").to_numpy(zero_copy_only=False))))
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets):
                sets = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([fingerprint(s) for s in sets], pa.binary()),
                    list_array(np.concatenate(sets), np.array([len(s) for s in sets]), pa.int64()),
                ], ["key", "hashes"])

    found = docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(work, "key binary, hashes array<bigint>")
    return found.join(wanted.select("key", "cid"), "key").groupBy("key").agg(
        F.first("cid").alias("cid"), F.first("hashes").alias("hashes")).drop("key")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that hold on their full sets."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("sa")), "a").join(
        sets.select(F.col("cid").alias("b"), F.col("hashes").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", common.alias("i"), (F.size("sa") + F.size("sb")).alias("s")).filter(
        100 * F.col("i") >= PERCENT * (F.col("s") - F.col("i"))).select("a", "b")


def near_components(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, text hash, n_shingles, component_id, kept."""
    rows = kept(sketches(docs, width=width), "sketches")
    classes = kept(classes_of(rows), "classes")
    lists = kept(inverted_lists(classes), "lists")
    stars = kept(likely(star_pairs(lists), classes), "stars")
    sets = _sets_for(docs, classes, stars, width)
    first = kept(confirmed(stars, sets), "links")
    roots = _roots(first)
    placed = kept(families(stars, roots), "families")
    inside = kept(links_in_families(placed, sets), "links")
    rest = kept(cross_pairs(lists, placed, classes), "cross")
    across = confirmed(rest, _sets_for(docs, classes, rest, width))
    final = _roots(_edges(roots).unionByName(inside).unionByName(across))
    return named(rows, classes, final)


def _edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("u").alias("a"), F.col("root").alias("b"))


def _roots(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("v", "root")


def _sets_for(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    return kept(full_sets(docs, kept(classes.select("cid", "key", "th").join(involved, "cid", "left_semi"), "wanted"), width), "sets")


def named(rows: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Give every document the smallest doc_id of its component, and say which one stays."""
    placed = classes.select("cid", "key", "rep").join(roots, F.col("cid") == F.col("u"), "left").select(
        "key", "rep", F.coalesce("root", "cid").alias("root"))
    names = placed.groupBy("root").agg(F.min("rep").alias("name"), F.min("key").alias("least"))
    by_class = placed.join(names, "root").select(
        F.col("key").alias("c"), "name", (F.col("key") == F.col("least")).alias("first"))
    own = rows.select("doc_id", "th", "n", "key").join(by_class, F.col("key") == F.col("c"), "left")
    return own.select(
        "doc_id", "th", F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"), "first",
    ).select(
        "doc_id", "th", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"),
                   F.col("component_id").isNull() & F.coalesce("first", F.lit(True))).alias("kept"))


def one_of_each(docs: DataFrame, width: int = STAGE_SHINGLE) -> DataFrame:
    """One document of each component, with all its columns; of rows with one id and text one stays."""
    stay = near_components(docs, width).filter("kept").select(
        F.col("doc_id").alias("__stay_id"), F.col("th").alias("__stay_th")).distinct()
    marked = docs.withColumn("__own_th", F.xxhash64("text"))
    on = (F.col("__own_th") == F.col("__stay_th")) & F.col("doc_id").eqNullSafe(F.col("__stay_id"))
    return marked.join(stay, on, "left_semi").dropDuplicates(["doc_id", "__own_th"]).drop("__own_th")
