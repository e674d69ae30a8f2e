"""Vector code compression: every vector becomes one codebook index per part, through metric trees.

Rows travel in blocks. Of each block and part position an anchors hierarchy is built once: about
sqrt(n) anchors steal each other's points, anchors merge pairwise upwards into a binary tree of balls,
and each anchor is divided again in the same way below (middle-out). A ball keeps its centre, radius,
and the cached sum and count of its points. The trees are written to the shared folder and read by
every round.

A round walks the trees from the top with the list of entries that may be nearest to some point of a
ball. A ball inherits its parent's list and drops the entries that another one beats at every point
of it; once one entry is left, the ball is wholly owned and its cached sum and count go there without
a look at its points. Leaves compare their points with what is left of the list, in integers. So the
result is that of comparing every part with every entry. Only sums per entry travel between tasks,
and at most PARTS * ENTRIES of them reach the driver.

Dropped rows: the vector is null, holds null or non-finite components, or its length is no positive
multiple of the number of parts or differs from that of the first kept vector (the least vec_id;
rows without one come last). Components beyond 2**27 in size count as 2**27, so that squares fit 64
bits. Rows that repeat are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloom.llm.shared import kept

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 4096
LEAF = 16
LARGEST = 1 << 27


class Trees(NamedTuple):
    """The balls of one part position of a block; ball 0 is the top of the tree."""

    order: np.ndarray  # points of the block, so that those of a ball stand together
    span: np.ndarray  # (balls, 2): first and last + 1 of the ball in ``order``
    child: np.ndarray  # (balls, 2): the balls below, -1 in a leaf
    centre: np.ndarray  # (balls, width)
    radius: np.ndarray  # distance of the farthest point from the centre
    total: np.ndarray  # (balls, width): sum of the points


def anchors(points: np.ndarray, n: int) -> np.ndarray:
    """For each point the number of the anchor that owns it; at most n anchors.

    A new anchor is the point farthest from the anchor of largest radius. It takes the points that
    are nearer to it; those nearer to their owner than half the way between both are not measured.
    """
    owner = np.zeros(len(points), np.int64)
    pivots = [points[0]]
    far = np.sqrt(((points - pivots[0]) ** 2).sum(1))
    while len(pivots) < n:
        pivot = int(far.argmax())
        if far[pivot] == 0:
            break
        half = np.sqrt(((np.array(pivots) - points[pivot]) ** 2).sum(1)) / 2
        near = np.flatnonzero(far >= half[owner])
        away = np.sqrt(((points[near] - points[pivot]) ** 2).sum(1))
        taken = away < far[near]
        owner[near[taken]], far[near[taken]] = len(pivots), away[taken]
        pivots.append(points[pivot])
    return owner


def _merges(centre: np.ndarray, radius: np.ndarray, count: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to join, smallest joined ball first; ball k + j comes from the j-th pair."""
    k = len(centre)
    c = np.concatenate((centre, np.zeros((k - 1, centre.shape[1]))))
    r, n = np.concatenate((radius, np.zeros(k - 1))), np.concatenate((count, np.zeros(k - 1)))

    def sizes(a: int, others: np.ndarray) -> np.ndarray:
        gap = np.sqrt(((c[others] - c[a]) ** 2).sum(1))
        return np.maximum(np.maximum(r[a], r[others]), (gap + r[a] + r[others]) / 2)

    cost = np.full((2 * k - 1, 2 * k - 1), np.inf)
    for a in range(k):
        cost[a, a + 1 : k] = sizes(a, np.arange(a + 1, k))
    alive, pairs = np.arange(2 * k - 1) < k, []
    for new in range(k, 2 * k - 1):
        a, b = divmod(int(cost.argmin()), 2 * k - 1)
        pairs.append((a, b))
        r[new] = cost[a, b]
        n[new] = n[a] + n[b]
        c[new] = (c[a] * n[a] + c[b] * n[b]) / n[new]
        cost[[a, b]] = np.inf
        cost[:, [a, b]] = np.inf
        alive[[a, b]] = False
        others = np.flatnonzero(alive)
        cost[others, new] = sizes(new, others)
        alive[new] = True
    return pairs


def hierarchy(points: np.ndarray) -> Trees:
    """The tree over integer points of one part position (at least one point)."""
    exact, points = points, points.astype(np.float64)
    order: list[np.ndarray] = []
    spans: list[list[int]] = []
    children: list[tuple[int, int]] = []
    done = 0

    def ball() -> int:
        spans.append([done, done])
        children.append((-1, -1))
        return len(spans) - 1

    # Work list instead of recursion: (ball, points of it) or, behind them, a ball to close.
    todo: list = [(ball(), np.arange(len(points)))]
    while todo:
        at, members = todo.pop()
        if members is None:
            spans[at] = [spans[children[at][0]][0], spans[children[at][1]][1]]
            continue
        spans[at][0] = done
        owner = anchors(points[members], int(len(members) ** 0.5)) if len(members) > LEAF else None
        if owner is None or not owner.any():
            order.append(members)
            done += len(members)
            spans[at][1] = done
            continue
        own = np.argsort(owner, kind="stable")
        groups = np.split(members[own], np.flatnonzero(np.diff(owner[own])) + 1)
        centre = np.array([points[g].mean(0) for g in groups])
        radius = np.array([np.sqrt(((points[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centre)])
        pairs = _merges(centre, radius, np.array([len(g) for g in groups], np.float64))
        # Top-down from the last pair, which is the ball itself; left sides are worked off first.
        open_ = [(at, len(groups) + len(pairs) - 1)]
        plan: list = []
        while open_:
            node, k = open_.pop()
            if k < len(groups):
                plan.append((node, groups[k]))
                continue
            left, right = ball(), ball()
            children[node] = (left, right)
            plan.append((node, None))
            open_ += [(right, pairs[k - len(groups)][1]), (left, pairs[k - len(groups)][0])]
        # ``plan`` is in preorder; the stack needs leaves in order, and each joined ball behind them.
        closing = [x for x in plan if x[1] is None]
        todo += [*closing, *[x for x in reversed(plan) if x[1] is not None]]
    span, child = np.array(spans, np.int32), np.array(children, np.int32)
    flat = np.concatenate(order).astype(np.int32)
    running = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(exact[flat], axis=0)))
    total = running[span[:, 1]] - running[span[:, 0]]
    centre = total / (span[:, 1] - span[:, 0])[:, None]
    radius = np.zeros(len(span))
    level = np.zeros(1, np.int64)
    while len(level):
        size = (span[level, 1] - span[level, 0]).astype(np.int64)
        start = np.cumsum(size) - size
        at = np.repeat(span[level, 0] - start, size) + np.arange(int(size.sum()))
        away = ((points[flat[at]] - np.repeat(centre[level], size, axis=0)) ** 2).sum(1)
        radius[level] = np.sqrt(np.maximum.reduceat(away, start))
        below = child[level].ravel()
        level = below[below >= 0].astype(np.int64)
    return Trees(flat, span, child, centre, radius, total)


def assign(points: np.ndarray, tree: Trees, entries: np.ndarray):
    """The nearest entry of each point (ties to the lower index), and sum and count of each entry."""
    k = len(entries)
    sums, counts = np.zeros_like(entries), np.zeros(k, np.int64)
    codes = np.empty(len(points), np.int64)
    # Of equal entries the first has all points: the others are no candidates anywhere.
    _, first = np.unique(entries, axis=0, return_index=True)
    mask = np.zeros((1, k), bool)
    mask[0, first] = True
    level = np.zeros(1, np.int64)
    floats = entries.astype(np.float64)
    while len(level):
        away = np.sqrt(((tree.centre[level, None, :] - floats[None]) ** 2).sum(2))
        away[~mask] = np.inf
        radius = tree.radius[level, None]
        # An entry stays unless another one is nearer by more than the ball's diameter.
        bound = away.min(axis=1, keepdims=True) + 2 * radius
        mask = mask & (away <= bound * (1 + 1e-9) + 1e-6)
        owned = mask.sum(1) == 1
        for ball, entry in zip(level[owned].tolist(), mask[owned].argmax(1).tolist()):
            a, b = tree.span[ball]
            codes[tree.order[a:b]] = entry
            sums[entry] += tree.total[ball]
            counts[entry] += b - a
        leaf = ~owned & (tree.child[level, 0] < 0)
        if leaf.any():
            size = (tree.span[level[leaf], 1] - tree.span[level[leaf], 0]).astype(np.int64)
            at = np.repeat(tree.span[level[leaf], 0] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            members = tree.order[at]
            squares = ((points[members, None, :] - entries[None]) ** 2).sum(2)
            squares[~np.repeat(mask[leaf], size, axis=0)] = np.iinfo(np.int64).max
            best = squares.argmin(1)
            codes[members] = best
            np.add.at(sums, best, points[members])
            counts += np.bincount(best, minlength=k)
        go = ~owned & ~leaf
        mask, level = np.repeat(mask[go], 2, axis=0), tree.child[level[go]].ravel().astype(np.int64)
    return codes, sums, counts


# --- Spark -------------------------------------------------------------------------------------

_FIELDS = (("ordering", np.int32), ("span", np.int32), ("child", np.int32), ("centre", np.float64),
           ("radius", np.float64), ("total", np.int64))


def whole_vectors(vectors: DataFrame, vector: str, parts: int) -> DataFrame:
    """vec_id, v (doubles) and label of the rows whose vector can be cut into parts."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite).select(
        "vec_id", v.alias("v"), "label")


def trees(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """One row per block: vec_ids, labels, integer points, and the trees of all part positions."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), BLOCK):
                block = batch.slice(low, BLOCK)
                values = block.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
                whole = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)
                built = [hierarchy(whole[:, p * width : (p + 1) * width]) for p in range(parts)]
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                columns = [one(block.column("vec_id")), one(block.column("label")), pa.array([whole.tobytes()], pa.binary()),
                           pa.array([[len(t.span) for t in built]], pa.list_(pa.int32()))]
                columns += [pa.array([b"".join(t[k].astype(kind).tobytes() for t in built)], pa.binary())
                            for k, (_, kind) in enumerate(_FIELDS)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "points", "balls", *[f for f, _ in _FIELDS]])

    return rows.mapInArrow(
        work, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, points binary, balls array<int>, "
        + ", ".join(f"{f} binary" for f, _ in _FIELDS))


def _blocks(batch: pa.RecordBatch, width: int, parts: int):
    """Of each row its number, the integer points and the trees."""
    for row in range(len(batch)):
        points = np.frombuffer(batch.column("points")[row].as_py(), np.int64).reshape(-1, parts * width)
        balls = np.array(batch.column("balls")[row].as_py())
        ends, n = np.concatenate(([0], np.cumsum(balls))), len(points)
        f = {name: np.frombuffer(batch.column(name)[row].as_py(), kind) for name, kind in _FIELDS}
        f = {"ordering": f["ordering"].reshape(parts, n), "span": f["span"].reshape(-1, 2), "child": f["child"].reshape(-1, 2),
             "centre": f["centre"].reshape(-1, width), "radius": f["radius"], "total": f["total"].reshape(-1, width)}
        yield row, points, [
            Trees(f["ordering"][p], *[f[name][ends[p] : ends[p + 1]] for name, _ in _FIELDS[1:]]) for p in range(parts)]


def moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor of the mean of what each entry owns."""
    parts, entries, width = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, points, built in _blocks(batch, width, parts):
                for p, tree in enumerate(built):
                    _, s, c = assign(points[:, p * width : (p + 1) * width], tree, books[p])
                    sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]),
             pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = blocks.drop("vec_id", "label").mapInArrow(work, "part int, entry int, n bigint, sums array<bigint>")
    out = books.copy()
    for r in found.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums")).collect():
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out


def codes(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    parts, _, width = books.shape
    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema if f.name in ("vec_id", "label")}
    hexes = np.array([f"{k:02x}" for k in range(256)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, points, built in _blocks(batch, width, parts):
                found = np.empty((len(points), parts), np.int64)
                error = np.zeros(len(points), np.int64)
                for p, tree in enumerate(built):
                    own = points[:, p * width : (p + 1) * width]
                    found[:, p] = assign(own, tree, books[p])[0]
                    error += ((own - books[p][found[:, p]]) ** 2).sum(1)
                text = ["".join(x) for x in hexes[found]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id")[row].values, batch.column("label")[row].values, pa.array(text, pa.string()), pa.array(error)],
                    ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(work, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compressed(
    vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept row, and the codebooks (part, entry, component).

    The codebooks start as the parts of the ``entries`` (256 at most) least vec_ids; with fewer rows
    there are fewer entries. ``rounds`` times all parts are assigned and the entries moved.
    """
    rows = whole_vectors(vectors, vector, parts)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    length = len(first[0]["v"]) if first else parts
    rows = rows.filter(F.size("v") == length)
    start = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    whole = np.clip(np.floor(np.array(start, np.float64).reshape(len(start), length) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    books = np.ascontiguousarray(whole.reshape(len(start), parts, length // parts).transpose(1, 0, 2))
    blocks = kept(trees(rows, length // parts, parts), "balls")
    for _ in range(rounds if len(start) else 0):
        books = moved(blocks, books)
    return kept(codes(blocks, books), "codes"), books


def code_digest(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    coded, books = compressed(vectors, vector)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
