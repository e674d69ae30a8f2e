"""Ranked search, language-model scores and vector codes, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import FOLDER

from workloom.llm import impact_search, log_bilinear, queries, vector_codes
from workloom.llm.arrays import flat

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# --- ranked search -----------------------------------------------------------------------------


def plain_ranks(docs, items, k=10):
    """(item number, rank, doc_id, score) over lists of (id, text)."""
    bags = [Counter(TERM.findall(brute.small(t))) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for at, (_, text) in enumerate(items):
        found = []
        for (doc, _), bag, size in zip(docs, bags, sizes):
            m = 25 + (75 * size * n_docs) // max(n_terms, 1)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t, n in Counter(TERM.findall(brute.small(text))).items() if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(at, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return out


def rows_of(frame):
    return sorted(tuple(map(str, r)) for r in frame.select("item_id", "rank", "doc_id", "score").collect())


def test_ranks_of_all_documents(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = plain_ranks([(i, r["text"]) for i, r in texts.items()], items)
    got = rows_of(queries.op11_impact_search(spark, FOLDER))
    assert got == sorted((str(items[a][0]), str(rank), str(d), str(s)) for a, rank, d, s in want)


ITEMS = [(1, "word3 said3 WORD3, long5 text5"), (1, "word3 said3 WORD3, long5 text5"), (None, "licensed x"), (2, None), (3, " .,"), (4, "çà nowhere")]


@pytest.mark.parametrize(("shard", "block"), [(1 << 23, 256), (1, 1)])
def test_ranks_of_odd_rows(spark, odd, monkeypatch, shard, block):
    monkeypatch.setattr(impact_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(impact_search, "ITEM_BLOCK", block)
    items = spark.createDataFrame([(i, t, "?") for i, t in ITEMS], "item_id bigint, text string, score string")
    want = plain_ranks([(r["doc_id"], r["text"]) for r in odd.collect()], ITEMS)
    assert rows_of(impact_search.ranked(odd, items)) == sorted((str(ITEMS[a][0]), str(rank), str(d), str(s)) for a, rank, d, s in want)


def test_ranks_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert impact_search.ranked(none, items).count() == 0
    assert impact_search.ranked(odd, items.limit(0)).count() == 0


def test_nra_finds_the_best_with_ties():
    rng = np.random.default_rng(5)
    for trial in range(60):
        size, k = int(rng.integers(1, 1500)), int(rng.integers(1, 12))
        lists, total = [], np.zeros(size, np.int64)
        for _ in range(int(rng.integers(1, 9))):
            rows = rng.permutation(size)[: int(rng.integers(1, size + 1))]
            impacts = np.sort(rng.integers(0, 4 if trial % 2 else 10_000, len(rows)))[::-1].astype(np.int64)
            total[rows] += impacts
            lists.append((rows, impacts))
        rows, scores = impact_search.nra(lists, size, k)
        assert (total[rows] == scores).all()
        least = max(1, np.sort(total)[-k]) if size > k else 1
        assert set(np.flatnonzero(total >= least)) == set(rows)


# --- language-model scores ----------------------------------------------------------------------


def plain_scores(docs):
    """Per row of (id, text): held_out, n_tokens, n_known, N, base score."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    bags = [[*brute.WORD.findall(brute.small(t)), None] for _, t in docs]
    counts = Counter(w for b, h in zip(bags, held) if not h for w in b)
    n, v = sum(counts.values()), len(counts)
    return [(h, len(b), sum(counts[w] > 0 for w in b), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in b))
            for h, b in zip(held, bags)]


def check_base(got, docs):
    want = {}
    for (i, _), row in zip(docs, plain_scores(docs)):
        want.setdefault(i, []).append(row)
    found = {}
    for r in got:
        assert r["score"] < 0 and math.isfinite(r["score"])
        found.setdefault(r["doc_id"], []).append((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]))
    assert found.keys() == want.keys()
    for i, rows in want.items():
        for a, b in zip(sorted(rows), sorted(found[i]), strict=True):
            assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_scores_of_all_documents(spark, texts):
    got = queries.op12_log_bilinear(spark, FOLDER).collect()
    check_base(got, [(i, r["text"]) for i, r in texts.items()])
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)  # less negative by 3 % at least


@pytest.mark.parametrize("listed", [log_bilinear.LISTED, 400])
def test_base_scores_of_odd_rows(spark, odd, monkeypatch, listed):
    monkeypatch.setattr(log_bilinear, "LISTED", listed)
    monkeypatch.setattr(log_bilinear, "WARM_TOKENS", 20_000)
    check_base(log_bilinear.scored(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])


def test_scores_without_training_rows(spark, none):
    assert log_bilinear.scored(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row, = log_bilinear.scored(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert row["n_tokens"] == 3 and row["n_known"] == row["train_tokens"] == 0 and row["base_score"] == 0


def test_probabilities_add_up():
    rng = np.random.default_rng(2)
    start = log_bilinear.Model.start(np.full(log_bilinear.TYPES, 1 / log_bilinear.TYPES))
    for scale in (1, 50):
        model = start._replace(context=start.context * scale, target=start.target * scale)
        before = np.repeat(rng.integers(0, log_bilinear.TYPES + 1, (3, log_bilinear.CONTEXT)), log_bilinear.TYPES, axis=0)
        found = model.log_probabilities(np.tile(np.arange(log_bilinear.TYPES), 3), before)
        assert np.allclose(np.exp(found).reshape(3, -1).sum(1), 1, atol=1e-4)


def test_contexts_stay_inside_a_row():
    data, offsets = flat(pa.array(["B a", None, "a"]))
    t = log_bilinear.tokens(data, offsets)
    ids, before, bounds = log_bilinear.sequences(t, np.array([[b"a", b"b"].index(w) for w in t.words.to_pylist()]))
    end, start = log_bilinear.END, log_bilinear.START
    assert ids.tolist() == [1, 0, end, end, 0, end] and bounds.tolist() == [0, 3, 4, 6]
    assert before[:, 0].tolist() == [start, 1, 0, start, start, 0] and before[2].tolist() == [0, 1, start]


# --- vector codes --------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """{row number: (code, error)} and the codebooks' digest, for (vec_id, vector) in order."""
    whole = np.array([[math.floor(256 * x) for x in v] for _, v in rows], np.int64)
    width, books = whole.shape[1] // parts, []
    codes, error = np.zeros((len(rows), parts), int), np.zeros(len(rows), int)
    for p in range(parts):
        x = whole[:, p * width : (p + 1) * width]
        book = x[:entries].copy()
        for _ in range(rounds):
            best = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
            for e in set(best.tolist()):
                book[e] = [int(s) // int((best == e).sum()) for s in x[best == e].sum(0)]
        squares = ((x[:, None] - book[None]) ** 2).sum(2)
        codes[:, p] = squares.argmin(1)
        error += squares.min(1)
        books.append(book)
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    return ["".join(f"{c:02x}" for c in row) for row in codes], error.tolist(), digest


def check_codes(got, rows, labels):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    code, error, digest = plain_codes(rows)
    by_label = Counter()
    for (i, v), e in zip(rows, error):
        by_label[labels[i, tuple(v)]] += e
    want = [(i, c, e, by_label[labels[i, tuple(v)]], digest) for (i, v), c, e in zip(rows, code, error)]
    found = [(r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_codes_of_all_vectors(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    got = queries.op13_vector_codes(spark, FOLDER).collect()
    check_codes(got, [(r["vec_id"], r["embedding"]) for r in table], {(r["vec_id"], tuple(r["embedding"])): r["label"] for r in table})


def test_codes_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    good = [(i, rng.integers(-3, 4, 32).astype(float).tolist(), (None, 1, 2)[i % 3]) for i in range(200)]
    good += [good[5], good[5], (None, [0.5] * 32, 1), (7, [-0.001] * 32, 2)]
    bad = [(300, None, 1), (301, [], 1), (302, [None] * 32, 1), (303, [float("nan")] + [0.0] * 31, 1),
           (304, [float("-inf")] * 32, None), (305, [1.0] * 31, 1), (306, [1.0] * 48, 1)]
    frame = spark.createDataFrame([(*r, "?") for r in good + bad], "vec_id bigint, embedding array<double>, label int, code string")
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    labels = {(i, tuple(v)): x for i, v, x in good}
    check_codes(vector_codes.code_digest(frame).collect(), [(i, v) for i, v, _ in good], labels)
    assert vector_codes.code_digest(frame.limit(0)).count() == 0
    few = frame.filter("vec_id IN (1, 2, 302)")
    check_codes(vector_codes.code_digest(few).collect(), [(i, v) for i, v, _ in good if i in (1, 2)], labels)


def test_balls_hold_their_points():
    rng = np.random.default_rng(1)
    for n, spread in ((1, 9), (40, 2), (700, 30), (700, 0)):
        points = rng.integers(-spread, spread + 1, (n, 4))
        tree = vector_codes.hierarchy(points)
        for (a, b), centre, radius, total, (left, right) in zip(tree.span, tree.centre, tree.radius, tree.total, tree.child):
            own = points[tree.order[a:b]]
            assert (own.sum(0) == total).all() and np.sqrt(((own - centre) ** 2).sum(1)).max() <= radius + 1e-9
            assert left < 0 or (tree.span[left][0], tree.span[left][1], tree.span[right][1]) == (a, tree.span[right][0], b)
