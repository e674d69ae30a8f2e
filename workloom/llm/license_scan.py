"""Licence scan: a positional index of rare licence words.

The words of the licence templates are the vocabulary; document frequencies of its words are
counted over all documents. The index has postings of each template's ``RARE_WORDS`` highest-IDF words,
and of the rarest word of each mandatory phrase: word -> (template, place). Every place of such a word
in a document votes for the alignments (template, document place less template place) of its postings. An
alignment is taken if ``AGREE`` of the template's rare places outside the mandatory phrase vote for
it, up to ``DRIFT`` words off, and the phrase stands there word for word; its score is the share of template
words in place. So a phrase alone is no licence, unless the template is hardly more than the phrase, and
a licence with words replaced or a few added is found as long as a phrase is whole.

Base places are the phrases of ``BASE``. Null or empty texts have no words. Rows are judged one by
one, so repeated rows get equal results. Templates are a parameter: (label, text, mandatory phrases).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workloom.llm.arrays import SIGNS, byte_codes, find_words, flat, slices, span_hashes

#: Phrases and their labels.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Label, notice, mandatory phrases (one of them must stand in the alignment).
TEMPLATES = (
    ("mit-terms",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction including "
     "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
     "copies of the software",
     ("permission is hereby granted free of charge",)),
    ("apache-2.0",
     "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license you may obtain a copy of the license at",
     ("apache license version 2 0",)),
    ("gpl-3.0",
     "this work is licensed under the gnu general public license version 3",
     ("gnu general public license version 3",)),
    ("gpl-notice",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation either version 3 of the license "
     "or at your option any later version",
     ("terms of the gnu general public license", "published by the free software foundation")),
    ("bsd",
     "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met",
     ("redistribution and use in source and binary forms",)),
    ("mpl-2.0",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
     "mpl was not distributed with this file you can obtain one at",
     ("mozilla public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("isc",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
     ("with or without fee is hereby granted",)),
    ("unlicense",
     "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)
Template = tuple[str, str, tuple[str, ...]]
#: Highest-IDF words of a template that have postings.
RARE_WORDS = 12
#: Share of a template's rare places outside the phrase that must vote for an alignment.
AGREE = 0.5
#: Words by which a vote may lie off the alignment.
DRIFT = 3


class Index:
    """Vocabulary and templates as arrays of word numbers, and the postings of rare words."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES) -> None:
        texts = [phrase for phrase, _ in BASE] + [text for _, text, _ in templates]
        self.words = sorted({w for text in texts for w in text.split()})
        number = {w: k for k, w in enumerate(self.words)}
        data, offsets = flat(pa.array(self.words, pa.string()))
        hashes = span_hashes(data, offsets[:-1], offsets[1:], byte_codes(fold_case=True))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        run = lambda text: np.array([number[w] for w in text.split()])
        self.base = [(run(phrase), label) for phrase, label in BASE]
        self.labels = [label for label, _, _ in templates]
        self.templates = [run(text) for _, text, _ in templates]
        self.phrases = [[run(p) for p in phrases] for _, _, phrases in templates]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)

    def post(self, idf: np.ndarray) -> None:
        """Postings by word, and per template the ways to hold it: where a phrase stands, and the rare
        places outside of it."""
        rows, self.ways = [], []
        for t, (template, phrases) in enumerate(zip(self.templates, self.phrases)):
            words = np.unique(template)
            rare = words[np.argsort(-idf[words], kind="stable")][:RARE_WORDS]
            rare = np.union1d(rare, [p[np.argmax(idf[p])] for p in phrases])
            places = np.flatnonzero(np.isin(template, rare))
            rows += [(template[k], t, k) for k in places.tolist()]
            self.ways.append([
                (phrase, inside, outside, math.ceil(AGREE * len(outside)))
                for phrase in phrases for inside in _found(template, phrase).tolist()
                for outside in [places[(places < inside) | (places >= inside + len(phrase))]]])
        rows = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.template_of, self.place_of = rows[:, 1], rows[:, 2]
        self.first = np.searchsorted(rows[:, 0], np.arange(len(self.words) + 1))
        #: Votes without which no way of a template holds; the phrase has one of its own.
        self.least = np.array([1 + min((need for *_, need in ways), default=len(self.words)) for ways in self.ways])

    def votes(self, numbers: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(doc, template, shift, template place) of all rare words of a slice, in this order."""
        known = np.flatnonzero(numbers >= 0)
        low, size = self.first[numbers[known]], np.diff(self.first)[numbers[known]]
        word = np.repeat(known, size)
        posting = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
        d, t, q = doc[word], self.template_of[posting], self.place_of[posting]
        shift = place[word] - q
        order = np.lexsort((q, shift, t, d))
        return d[order], t[order], shift[order], q[order]


def _found(numbers: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where a phrase stands in a run of word numbers."""
    n = len(numbers) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = numbers[:n] == phrase[0]
    for k in range(1, len(phrase)):
        hit &= numbers[k : k + n] == phrase[k]
    return np.flatnonzero(hit)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, list[int]]:
    """Number of documents, and of those that contain each vocabulary word (a bounded list)."""
    index = Index(templates)
    size = len(index.words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, total, rows = byte_codes(fold_case=True), np.zeros(size, np.int64), 0
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            rows += batch.num_rows
            for low, high in slices(offsets):
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                words = find_words(part, at, SIGNS)
                numbers = index.numbers(span_hashes(part, words.start, words.end, codes))
                known = numbers >= 0
                pairs = np.unique(words.doc[known] * size + numbers[known])
                total += np.bincount(pairs % size, minlength=size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, size), pa.int64()), pa.array(np.concatenate(([rows], total)), pa.int64())],
            ["word", "n"])

    counts = docs.select("text").mapInArrow(work, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}  # one row per vocabulary word
    return found.get(-1, 0), [found.get(k, 0) for k in range(size)]


def alignments(index: Index, numbers: np.ndarray, words) -> Iterator[tuple[int, str, float]]:
    """(row, label, score) of the alignments of a slice that hold."""
    d, t, shift, q = index.votes(numbers, words.doc, np.arange(len(numbers)) - words.first[words.doc])
    if not len(d):
        return
    # One number that keeps the order of (row, template, shift), with room for the drift.
    longest = max(map(len, index.templates))
    wide = int(np.diff(words.first).max()) + longest + 4 * DRIFT
    key = (d * len(index.templates) + t) * wide + shift + longest + DRIFT
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    low, high = np.searchsorted(key, key[first] - DRIFT), np.searchsorted(key, key[first] + DRIFT, "right")
    for k in np.flatnonzero(high - low >= index.least[t[first]]).tolist():
        at, template = first[k], index.templates[t[first[k]]]
        begin, end = words.first[d[at]], words.first[d[at] + 1]
        places = np.unique(q[low[k] : high[k]])
        start = begin + shift[at]
        for phrase, inside, outside, need in index.ways[t[at]]:
            x, y = start + inside, start + inside + len(phrase)
            if begin <= x and y <= end and len(np.intersect1d(places, outside, assume_unique=True)) >= need and (
                    numbers[x:y] == phrase).all():
                x, y = max(start, begin), min(start + len(template), end)
                yield int(d[at]), index.labels[t[at]], float((template[x - start : y - start] == numbers[x:y]).sum()) / len(template)
                break


def scanned(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document: words, base places and labels, all labels, and the score of the best template."""
    index = Index(templates)
    rows, counts = document_frequencies(docs, templates)
    index.post(np.array([math.log((rows + 1) / (n + 1)) for n in counts]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(fold_case=True)
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in slices(offsets):
                part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                words = find_words(part, at, SIGNS)
                numbers = index.numbers(span_hashes(part, words.start, words.end, codes))
                n = high - low
                places = [[] for _ in range(n)]
                base: list[set[str]] = [set() for _ in range(n)]
                for phrase, label in index.base:
                    hits = _found(numbers, phrase)
                    for hit in hits[words.doc[hits] == words.doc[hits + len(phrase) - 1]].tolist():
                        row = int(words.doc[hit])
                        places[row].append(hit - int(words.first[row]))
                        base[row].add(label)
                labels, scores = [set(x) for x in base], [0.0] * n
                for row, label, share in alignments(index, numbers, words):
                    labels[row].add(label)
                    scores[row] = max(scores[row], share)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(low, n),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array([len(x) for x in places], pa.int64()),
                    pa.array([min(x, default=None) for x in places], pa.int64()),
                    pa.array([max(x, default=None) for x in places], pa.int64()),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                    pa.array(scores, pa.float64()),
                ], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
              "base_labels string, labels string, score double")
