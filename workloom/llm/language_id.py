"""Language identification: averaged hashed subword embeddings under a linear softmax.

Features are byte n-grams of 2 to 4 bytes (ASCII letters folded, runs across blanks included),
hashed into ``BUCKETS``. A document is the mean of its grams' embeddings; a linear layer and a
softmax give the language. Embeddings and layer are trained by stochastic gradient descent in numpy
on a bounded sample: about ``SAMPLE`` labelled documents per language, chosen by a hash of their id,
of which each contributes its distinct buckets, at most ``BUCKETS`` of them. One part of the sample
fits the model, another sets the softmax temperature and the score below which a prediction counts
as rejected (``accepted`` is false).

Because the model is linear after averaging, embeddings and layer are multiplied out into one table
of a row per bucket before prediction; its size is fixed by BUCKETS and the number of languages.

A text that is null or has no letter gets ``und`` with score 0 and is not accepted; so does every
text if no row is labelled. Documents without an id are never learned from and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloom.llm.arrays import flat, list_array, slices

BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
SAMPLE = 400
DIMENSIONS = 16
EPOCHS = 6
RATE = 20.0
#: Share of accepted calibration documents that must be right.
PRECISION = 0.99
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # bucket x language, log-odds of a gram before averaging
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of one order inside each row, and n + 1 offsets into them."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    folded = _FOLD[data]
    key = np.full(n, order, np.uint32)
    for k in range(order):
        key = key * np.uint32(257) + folded[k : k + n]
    bucket = ((key * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)
    size = np.maximum(np.diff(offsets) - order + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(size)))
    if bounds[-1] < n:  # grams that reach into the next row go
        row_end = np.repeat(offsets[1:], np.diff(offsets))
        bucket = bucket[np.arange(n) + order <= row_end[:n]]
    return bucket, bounds


def sample(docs: DataFrame) -> list:
    """Rows (lang, fold, buckets, counts) of the training sample."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    labelled = docs.select("doc_id", "text", "lang", fold.cast("bigint").alias("fold")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("fold") != HELD_OUT))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    # A document is chosen if the hash of its id falls below its language's share.
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, SAMPLE / n)))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.filter(draw < F.element_at(share, F.col("lang")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets):
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                found = [grams(part, at, order) for order in ORDERS]
                buckets, counts, sizes = [], [], []
                for row in range(high - low):
                    u, c = np.unique(np.concatenate([b[s[row] : s[row + 1]] for b, s in found]), return_counts=True)
                    buckets.append(u)
                    counts.append(c)
                    sizes.append(len(u))
                yield pa.RecordBatch.from_arrays([
                    batch.column("lang").slice(low, high - low), batch.column("fold").slice(low, high - low),
                    list_array(np.concatenate(buckets), np.array(sizes), pa.int32()),
                    list_array(np.concatenate(counts), np.array(sizes), pa.int32()),
                ], ["lang", "fold", "buckets", "counts"])

    return chosen.select("text", "lang", "fold").mapInArrow(
        work, "lang string, fold bigint, buckets array<int>, counts array<int>").collect()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list) -> Model | None:
    """Fit the model on sampled rows; deterministic for given rows."""
    rows = sorted((r for r in rows if len(r["buckets"])), key=lambda r: (r["lang"], list(r["buckets"][:8]), len(r["buckets"])))
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    cases = [(np.array(r["buckets"]), np.array(r["counts"], np.float32) / sum(r["counts"]), number[r["lang"]],
              r["fold"] == CALIBRATION) for r in rows]
    fit = [c for c in cases if not c[3]] or cases
    check = [c for c in cases if c[3]] or fit
    rng = np.random.default_rng(7)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(fit)).tolist():
            ids, weight, label, _ = fit[k]
            rate = RATE * (1 - done / steps)
            hidden = weight @ embedding[ids]
            error = _softmax(hidden @ layer + bias)
            error[label] -= 1
            back = layer @ error
            # The embeddings' step is scaled up, because averaging scales their gradient down.
            layer -= 0.1 * rate / 2 * np.outer(hidden, error)
            bias -= 0.001 * rate * error
            embedding[ids] -= rate * weight[:, None] * back
            done += 1
    table = embedding @ layer
    logits = np.array([w @ table[ids] + bias for ids, w, _, _ in check])
    labels = np.array([c[2] for c in check])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    chance = _softmax(logits / temperature)
    score, right = chance.max(axis=1), chance.argmax(axis=1) == labels
    threshold = 1.0
    order = np.argsort(-score)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    if good.any():
        threshold = float(score[order][np.flatnonzero(good)[-1]])
    return Model(languages, table.astype(np.float32), bias, temperature, threshold)


def predict(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Language number and score of each row."""
    n = len(offsets) - 1
    total = np.zeros((n, len(model.languages)), np.float64)
    count = np.zeros(n, np.int64)
    for order in ORDERS:
        bucket, bounds = grams(data, offsets, order)
        size = np.diff(bounds)
        rows = np.flatnonzero(size)
        if len(rows):
            total[rows] += np.add.reduceat(model.table[bucket], bounds[:-1][rows], axis=0)
            count += size
    chance = _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
    return chance.argmax(axis=1), chance.max(axis=1)


def identified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted."""
    model = train(sample(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets):
                texts = batch.column("text").slice(low, high - low)
                letters = [any(map(str.isalpha, t.as_py() or "")) for t in texts]
                if model is None:
                    names, scores = ["und"] * len(texts), [0.0] * len(texts)
                else:
                    best, top = predict(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], model)
                    names = [model.languages[k] if has else "und" for k, has in zip(best.tolist(), letters)]
                    scores = [min(1.0, s) if has else 0.0 for s, has in zip(top.tolist(), letters)]
                sure = [model is not None and has and s >= model.threshold for s, has in zip(scores, letters)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, high - low), batch.column("held_out").slice(low, high - low),
                    pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_()),
                ], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    held = F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held).mapInArrow(
        work, "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")
