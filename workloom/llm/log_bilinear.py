"""Language-model scores by a log-bilinear model, trained in numpy with noise-contrastive estimation.

Tokens are lower-cased words (A-Z), then one end per document. The model's types are the ``WORDS``
most frequent training words, ``BUCKETS`` groups of all other words by their last three bytes, and
the end. The vectors of the CONTEXT previous types, weighted per place, predict a vector; its product
with a type's vector plus the type's bias is the score, and a softmax over all types normalises it:
one matrix product per block of tokens. A word of a group then takes its share of the group,
(c + 1) / (sum over the group's words of (c + 1), + 1 for unseen ones); so probabilities add up to 1 over
all known words and one unseen word per group.

Counts cover all training documents and grow with them. Training has two parts. A warm start on the
driver, over a sample of about SAMPLE_DOCS documents chosen by a hash of the id, gives a common
start. Then every task goes once through all of its training documents from there, and the
parameters are averaged by tokens, in groups of GROUP tasks at a time; so every training token
counts, and what travels is one model of fixed size per task.

The LISTED most frequent words are sent to all tasks with their counts (bounded). Occurrences of
other words are joined with the count table by word; none of them is frequent enough to be hot.

Null and empty texts are the end alone. Rows without doc_id are training rows. Rows that repeat count
and are scored each on their own. Without training rows all counts are 0 and the model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.llm.arrays import find_words, flat, list_array, mix, slices, small_letters, strings
from workloom.llm.shared import kept

WORDS, BUCKETS = 383, 128
TYPES = WORDS + BUCKETS + 1
END, START = TYPES - 1, TYPES
CONTEXT, WIDTH, NOISE = 3, 16, 32
LISTED = 1 << 18
SAMPLE_DOCS, WARM_TOKENS = 4000, 2_000_000
MINIBATCH, RATE, SWEEP_RATE = 2048, 0.1, 0.05
GROUP = 64
#: Bytes of text scored at once: the list of words is indexed once for each.
SLICE = 1 << 23
#: Tokens scored by one product, and the size of scores up to which exp needs no shift.
ROWS, SAFE = 128, 80
FOLDS, HELD_FOLD = 7, 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


# --- texts to types ----------------------------------------------------------------------------


class Tokens(NamedTuple):
    words: pa.Array  # distinct words of the slice
    bucket: np.ndarray  # of each distinct word
    word: np.ndarray  # number of the word of each occurrence
    first: np.ndarray  # occurrences before each row, n + 1 entries


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data = small_letters(data)
    found = find_words(data, offsets)
    coded = strings(data, found.start, found.end).dictionary_encode()
    flat_words, bounds = flat(coded.dictionary)
    tail = np.zeros(len(coded.dictionary), np.uint64)
    for k in (1, 2, 3):
        at = bounds[1:] - k
        there = at >= bounds[:-1]
        tail[there] = tail[there] * np.uint64(256) + flat_words[at[there]]
    return Tokens(coded.dictionary, (mix(tail + np.uint64(1)) % np.uint64(BUCKETS)).astype(np.int64), coded.indices.to_numpy(), found.first)


class Vocabulary(NamedTuple):
    """Words in order of falling counts, LISTED of them at most; the first WORDS are types."""

    words: pa.Array
    counts: np.ndarray

    def places(self, distinct: pa.Array, first: int = LISTED) -> np.ndarray:
        """Place of each word among the first ones of the list, -1 where it is not there."""
        return pc.index_in(distinct, value_set=self.words.slice(0, first)).fill_null(-1).to_numpy().astype(np.int64)


def sequences(t: Tokens, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Types of all rows with an end behind each row, the types before each (START where there is
    none), and n + 1 bounds."""
    kind = np.where((places >= 0) & (places < WORDS), places, WORDS + t.bucket)
    rows = len(t.first) - 1
    bounds = t.first + np.arange(rows + 1)
    ids = np.full(int(bounds[-1]), END, np.int64)
    inside = np.ones(len(ids), bool)
    inside[bounds[1:] - 1] = False
    ids[inside] = kind[t.word]
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
    before = np.full((len(ids), CONTEXT), START, np.int64)
    for k in range(1, CONTEXT + 1):
        before[k:, k - 1] = np.where(place[k:] >= k, ids[:-k], START)
    return ids, before, bounds


# --- the model ---------------------------------------------------------------------------------


class Model(NamedTuple):
    context: np.ndarray  # (TYPES + 1, WIDTH): vectors of types that stand before
    place: np.ndarray  # (CONTEXT, WIDTH): weights of the places
    target: np.ndarray  # (TYPES, WIDTH)
    bias: np.ndarray  # (TYPES,)

    @classmethod
    def start(cls, shares: np.ndarray) -> Model:
        rng = np.random.default_rng(12)
        return cls(rng.normal(0, 0.1, (TYPES + 1, WIDTH)), np.ones((CONTEXT, WIDTH)) / CONTEXT,
                   rng.normal(0, 0.1, (TYPES, WIDTH)), np.log(shares))

    @classmethod
    def of(cls, flat_values: np.ndarray) -> Model:
        parts, at = [], 0
        for shape in ((TYPES + 1, WIDTH), (CONTEXT, WIDTH), (TYPES, WIDTH), (TYPES,)):
            n = int(np.prod(shape))
            parts.append(flat_values[at : at + n].reshape(shape).copy())
            at += n
        return cls(*parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.place[k] * self.context[before[:, k]] for k in range(CONTEXT))

    def log_probabilities(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each type in its place."""
        out = np.empty(len(ids))
        single = Model(*[x.astype(np.float32) for x in self])
        weights = np.concatenate((single.target, single.bias[:, None]), axis=1).T.copy()
        ones, scores = np.ones(TYPES, np.float32), np.empty((ROWS, TYPES), np.float32)
        lines = np.arange(ROWS)
        longest = float(np.abs(single.bias).max()), float(np.sqrt((single.target**2).sum(1).max()))
        for low in range(0, len(ids), 32 * ROWS):
            vectors = np.ones((len(before[low : low + 32 * ROWS]), WIDTH + 1), np.float32)
            vectors[:, :WIDTH] = single.predicted(before[low : low + 32 * ROWS])
            bound = longest[0] + longest[1] * float(np.sqrt((vectors[:, :WIDTH] ** 2).sum(1).max()))
            own = np.empty(len(vectors), np.float32)
            total = np.empty(len(vectors), np.float32)
            for at in range(0, len(vectors), ROWS):
                n = len(own[at : at + ROWS])
                part = np.matmul(vectors[at : at + n], weights, out=scores[:n])
                if bound > SAFE:
                    part -= part.max(axis=1, keepdims=True)
                own[at : at + n] = part[lines[:n], ids[low + at : low + at + n]]
                np.exp(part, out=part)
                np.matmul(part, ones, out=total[at : at + n])
            out[low : low + len(vectors)] = own - np.log(total.astype(np.float64))
        return out


def _spread(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values of equal places, as a matrix of that many rows."""
    flat_at = (at[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    return np.bincount(flat_at, values.ravel(), rows * WIDTH).reshape(rows, WIDTH).astype(np.float32)


class Trainer:
    """Steps of noise-contrastive estimation with step sizes by accumulated squares of gradients."""

    def __init__(self, model: Model, squares: Model, shares: np.ndarray, rate: float, seed: int):
        self.model, self.squares = (Model(*[x.astype(np.float32) for x in m]) for m in (model, squares))
        self.rate = np.float32(rate)
        self.bounds, self.noise = np.cumsum(shares), (np.log(shares) + np.log(NOISE)).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def step(self, ids: np.ndarray, before: np.ndarray) -> None:
        m = self.model
        near = [m.context[before[:, k]] for k in range(CONTEXT)]
        hidden = sum(w * x for w, x in zip(m.place, near))
        drawn = np.minimum(np.searchsorted(self.bounds, self.rng.random(NOISE)), TYPES - 1)
        target, noise = m.target[ids], m.target[drawn]
        own = (hidden * target).sum(1) + (m.bias - self.noise)[ids]
        other = hidden @ noise.T
        other += (m.bias - self.noise)[drawn]
        # Pull towards the type that is there, away from the noise.
        up = 1 / (1 + np.exp(np.clip(own, -30, 30)))
        np.clip(other, -30, 30, out=other)
        down = -1 / (1 + np.exp(-other))
        back = up[:, None] * target + down @ noise
        on_target = _spread(ids, up[:, None] * hidden, TYPES)
        np.add.at(on_target, drawn, down.T @ hidden)
        on_bias = np.bincount(ids, up, TYPES) + np.bincount(drawn, down.sum(0), TYPES)
        on_context, on_place = np.zeros_like(m.context), np.zeros_like(m.place)
        for k in range(CONTEXT):
            on_context += _spread(before[:, k], m.place[k] * back, TYPES + 1)
            on_place[k] = (near[k] * back).sum(0)
        for value, square, slope in zip(m, self.squares, (on_context, on_place, on_target, on_bias.astype(np.float32))):
            square += slope * slope
            value += self.rate * slope / np.sqrt(square + np.float32(1e-8))
        self.seen += len(ids)

    def sweep(self, ids: np.ndarray, before: np.ndarray) -> None:
        for low in range(0, len(ids), MINIBATCH):
            self.step(ids[low : low + MINIBATCH], before[low : low + MINIBATCH])


# --- Spark -------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, bucket, c): occurrences of every word in all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets, 1 << 23):
                t = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays(
                    [t.words.cast(pa.binary()), pa.array(t.bucket, pa.int32()), pa.array(np.bincount(t.word, minlength=len(t.words)), pa.int64())],
                    ["word", "bucket", "c"])

    return docs.select("text").mapInArrow(work, "word binary, bucket int, c bigint").groupBy("word", "bucket").agg(
        F.sum("c").alias("c"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """The most frequent words, LISTED at most: as many whole bands of counts as fit, so that no task
    has to order the words of others."""
    band = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    room, least = LISTED, None
    for r in sorted(counts.groupBy(band.alias("band")).count().collect(), reverse=True):  # about a thousand bands
        room -= r["count"]
        if room < 0:
            break
        least = r["band"]
    return counts.filter(band >= least if least is not None else F.lit(False))


def _warm(sample: DataFrame, vocabulary: Vocabulary, shares: np.ndarray) -> Trainer:
    """The common start: passes over a bounded sample, WARM_TOKENS tokens in all at most."""
    table = sample.select("text").toArrow()
    trainer = Trainer(Model.start(shares), Model(*[np.full_like(x, 1e-2) for x in Model.start(shares)]), shares, RATE, 1)
    data, offsets = flat(table.column("text"))
    parts = []
    for low, high in slices(offsets):
        t = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        parts.append(sequences(t, vocabulary.places(t.words, WORDS))[:2])
    if parts:
        ids, before = (np.concatenate(x) for x in zip(*parts))
        while trainer.seen < WARM_TOKENS and len(ids):
            order = trainer.rng.permutation(len(ids))[: WARM_TOKENS - trainer.seen]
            trainer.sweep(ids[order], before[order])
    return trainer


def _averaged(models: DataFrame, tasks: int) -> np.ndarray | None:
    """Mean of (task, seen, values) by tokens seen, in groups of GROUP at a time."""

    def work(group: pa.Table) -> pa.Table:
        seen = group.column("seen").to_numpy().astype(np.float64)
        values = group.column("values").combine_chunks().flatten().to_numpy().reshape(len(seen), -1)
        mean = (values * (seen / seen.sum())[:, None]).sum(0)
        return pa.table({"task": group.column("up").slice(0, 1), "seen": pa.array([int(seen.sum())]),
                         "values": pa.array([mean], pa.list_(pa.float64()))})

    while True:
        tasks = -(-tasks // GROUP)
        models = models.withColumn("up", F.floor(F.col("task") / GROUP).cast("bigint")).groupBy("up").applyInArrow(
            work, "task bigint, seen bigint, values array<double>")
        if tasks <= 1:
            found = models.collect()
            return np.array(found[0]["values"]) if found else None


def trained(docs: DataFrame, vocabulary: Vocabulary, shares: np.ndarray, n_docs: int) -> Model:
    """The model after the warm start and one pass over all rows."""
    share = min(1.0, SAMPLE_DOCS / max(n_docs, 1))
    chosen = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < int(share * (1 << 30))
    warm = _warm(docs.filter(chosen), vocabulary, shares)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, shares, warm.model, warm.squares))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, noise, model, squares = sent.value
        task = TaskContext.get().partitionId()
        trainer = Trainer(model, squares, noise, SWEEP_RATE, task + 2)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets):
                t = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                ids, before, _ = sequences(t, words.places(t.words, WORDS))
                order = trainer.rng.permutation(len(ids))
                trainer.sweep(ids[order], before[order])
        if trainer.seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([task], pa.int64()), pa.array([trainer.seen], pa.int64()), pa.array([trainer.model.flat().astype(np.float64)], pa.list_(pa.float64()))],
                ["task", "seen", "values"])

    models = kept(docs.select("text").mapInArrow(work, "task bigint, seen bigint, values array<double>"), "models")
    mean = _averaged(models, docs.rdd.getNumPartitions())
    return warm.model if mean is None else Model.of(mean)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    train = docs.filter(~held_out()).select("doc_id", "text")
    n_docs = train.count()
    counts = kept(word_counts(train), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = total + n_docs, distinct + (n_docs > 0)
    top = most_frequent(counts).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    vocabulary = Vocabulary(top.column("word").combine_chunks().cast(pa.large_binary()), top.column("c").to_numpy())
    # What the groups hold: all words but those that are types.
    groups = np.array([(0, 0)] * BUCKETS, np.float64)
    for r in counts.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        groups[r["bucket"]] = r["c"], r["v"]
    types = top.slice(0, WORDS)
    np.subtract.at(groups, types.column("bucket").to_numpy(), np.stack((types.column("c").to_numpy(), np.ones(len(types))), axis=1))
    mass = np.log10(groups.sum(1) + 1)
    occurrences = np.concatenate((np.zeros(WORDS), groups[:, 0], [n_docs])) + 0.5
    occurrences[: len(types)] += types.column("c").to_numpy()
    model = trained(train, vocabulary, occurrences / occurrences.sum(), n_docs)
    logs, end = np.log10(vocabulary.counts + 1.0), float(np.log10(n_docs + 1.0))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model, logs, mass))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, own, log_counts, log_mass = sent.value
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets, SLICE):
                t = tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                places = listed.places(t.words)
                ids, before, bounds = sequences(t, places)
                row = np.repeat(np.arange(high - low), np.diff(bounds))
                size = np.diff(bounds)
                model_sum = np.bincount(row, own.log_probabilities(ids, before), high - low) / np.log(10)
                # Per occurrence of a word: its count where it is listed, its share where it is of a group.
                row = np.repeat(np.arange(high - low), np.diff(t.first))
                here = np.append(log_counts, 0.0)[places]
                grouped = (places < 0) | (places >= WORDS)
                inside = np.where(grouped, here - log_mass[t.bucket], 0.0)
                base = np.bincount(row, here[t.word], high - low) + end
                model_sum += np.bincount(row, inside[t.word], high - low)
                known = np.bincount(row, (places >= 0)[t.word], high - low).astype(np.int64) + (n_docs > 0)
                away = np.flatnonzero(places[t.word] < 0)
                pair, times = np.unique(row[away] * max(len(places), 1) + t.word[away], return_counts=True)
                at, word = pair // max(len(places), 1), pair % max(len(places), 1)
                per_row = np.bincount(at, minlength=high - low)
                ends = pa.array(np.concatenate(([0], np.cumsum(per_row))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(low, high - low) for c in ("row", "doc_id", "held_out")],
                    pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(model_sum),
                    pa.ListArray.from_arrays(ends, t.words.take(pa.array(word)).cast(pa.binary())),
                    list_array(times, per_row, pa.int32()),
                ], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model", "words", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = kept(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text").mapInArrow(
        work, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, model double, "
        "words array<binary>, times array<int>"), "scored")
    away = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", "x.words", "x.times")
    more = away.join(counts.select(F.col("word").alias("words"), "c"), "words").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("more"))
    extra = F.coalesce("more", F.lit(0.0))
    return rows.drop("words", "times").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("model") + extra).alias("score"))
