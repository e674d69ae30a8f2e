"""Operators that relate rows to each other, against plain versions."""

import hashlib
import io
import random
import struct
import zipfile

import brute
import numpy as np
import pytest
from compare import compare, connect
from conftest import FOLDER

from workloom.llm import compact_windows, near_copies, queries, template_leaks, web_archives
from workloom.llm.components import components
from workloom.llm.shared import file_system


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    note = compare(spark, connect(FOLDER), FOLDER, name, queries.QUERIES[name], queries.ORACLES[name])
    assert note is None, note


# --- components --------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    got = components(spark.createDataFrame(edges, "u int, v int")).collect()
    assert {r["u"]: r["v"] for r in got} == want and len(got) == len(want)


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "u int, v int")).count() == 0


# --- near copies -------------------------------------------------------------------------------


def test_short_lists_lose_only_members_that_no_other_fits(spark):
    rng = random.Random(31)
    rows = [(v, bytes([v, k]), rng.choice((10, 12, 13, 40, 51, 200)), size) for v in range(60) for size in ((near_copies.HOT,) if v % 7 == 0 else (5,))
            for k in range(rng.randrange(2, 6))]
    fits = lambda x, y: 100 * min(x, y) >= 80 * max(x, y)
    want = {r[:2] for r in rows if r[3] >= near_copies.HOT or any(
        o[0] == r[0] and o[1] != r[1] and fits(o[2], r[2]) for o in rows)}
    got = near_copies._with_partners(spark.createDataFrame(rows, "v bigint, cid binary, n bigint, size bigint")).collect()
    assert {(r.v, bytes(r.cid)) for r in got} == want and len(got) == len(want) < len(rows)


def test_lists_hold_only_values_that_a_class_of_a_fitting_size_shares(spark):
    rng, rows = random.Random(32), []
    for family, size in enumerate((4, 5, 12, 40, 48, 60, 400) * 2):
        values = rng.sample(range(family * 1000, family * 1000 + 900), min(size, near_copies.K))
        # Two similar classes, and one or two of other sizes that share all values by chance.
        rows += [(10 * family + k, n, values) for k, n in enumerate((size, size * 5 // 4, size * 3, size * 9)[: 3 + family % 2])]
    rows += [(1000 + k, 5 * 3 ** k, list(range(-1, -49, -1))) for k in range(4)]
    classes = spark.createDataFrame(rows, "cid bigint, n bigint, sketch array<bigint>")
    lists = {}
    for r in near_copies.inverted_lists(classes).collect():
        lists.setdefault(r.cid, set()).add(r.v)
    assert set(lists) == {c for c, _, _ in rows if c < 1000 and c % 10 < 2}
    for c in lists:
        assert len(lists[c] & lists[c // 10 * 10 + 1 - c % 10]) >= 4


def near(docs):
    return {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_copies.near_components(docs).collect()}


def expected(texts):
    root = brute.components(texts)
    return {(i, len(brute.shingles(t)), root[i], root[i] == i) for i, t in texts.items()}


def test_near_copies_of_edited_families(spark):
    """Chains at the threshold, large groups of near copies, and a phrase that all texts share."""
    rng, texts, i = random.Random(11), {}, 0
    for size, family in ((60, 40), (25, 30), (200, 20), (6, 12)):
        base = [f"w{rng.randrange(4000)}" for _ in range(size)]
        for _ in range(family):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, size // 8))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(4000)}"
            i += 1
            texts[i] = " ".join(["the common line of all", *words])
    for k in range(40):
        texts[1000 + k] = " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 40)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert near(docs) == expected(texts)


def test_near_copies_of_odd_rows(odd, none):
    rows = near_copies.near_components(odd).collect()
    assert len(rows) == odd.count() and near_copies.near_components(none).count() == 0
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    for i in (1, 2, 3):
        assert (by_id[i]["n_shingles"], by_id[i]["component_id"], by_id[i]["kept"]) == (0, i, True)
    assert {by_id[i]["component_id"] for i in (5, 6, 7)} == {5} and by_id[9]["component_id"] == 8
    assert by_id[12]["component_id"] == 11 and not by_id[12]["kept"]
    no_id = [r for r in rows if r["doc_id"] is None]
    assert sorted((r["component_id"] or 0, r["kept"]) for r in no_id) == [(0, True), (5, False)]
    stay = near_copies.one_of_each(odd)
    assert stay.columns == odd.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "")[0] for r in stay.collect()) == [0, 1, 2, 3, 4, 5, 8, 10, 11, 13, 14]


# --- passages ----------------------------------------------------------------------------------


def test_windows_are_the_nodes_of_the_tree():
    def nodes(values, low, high, width):
        if high - low + 1 >= width:
            at = low + int(np.argmin(values[low : high + 1]))
            yield max(low, at - width + 1), at, min(high, at + width - 1)
            yield from nodes(values, low, at - 1, width)
            yield from nodes(values, at + 1, high, width)

    rng = np.random.default_rng(2)
    for width in (1, 2, 5, 8):
        for top in (4, 10**6):
            values = rng.integers(0, top, 90).astype(np.uint64)
            bounds = np.array([0, 30, 30, 33, 90])
            got = set(zip(*(x.tolist() for x in compact_windows.compact_windows(values, bounds, width))))
            want = {(row, *node) for row in range(4)
                    for node in nodes(values[bounds[row] : bounds[row + 1]], 0, bounds[row + 1] - bounds[row] - 1, width)}
            assert got == want


def shared_passages(texts, words=50):
    seen = {}
    for i, text in texts.items():
        w = brute.WORD.findall(brute.small(text))
        for k in range(len(w) - words + 1):
            seen.setdefault(tuple(w[k : k + words]), set()).add(i)
    return set().union(*[s for s in seen.values() if len(s) > 1])


def named(rows):
    return {r["doc_id"] for r in rows} | {r["with_id"] for r in rows}


def test_repeated_passages_of_all_documents(spark, texts):
    got = named(queries.op4_repeated_passages(spark, FOLDER).collect())
    assert shared_passages({i: r["text"] for i, r in texts.items()}) <= got


def test_planted_passages(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(100_000)}"
    passage, line = [word() for _ in range(60)], [word() for _ in range(25)]
    near_one = list(passage)
    near_one[30:30] = ["inserted"]
    texts = {k: " ".join([word() for _ in range(80)] + line + [word() for _ in range(80)]) for k in range(1, 40)}
    for k, inner in ((50, passage), (51, passage), (52, near_one), (53, passage[:45])):
        texts[k] = " ".join([word() for _ in range(70 + k)] + inner + [word() for _ in range(90)])
    texts[60] = " ".join(line + passage[:52] + line)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = compact_windows.repeated_passages(docs).collect()
    assert named(rows) == {50, 51, 52, 60}
    for r in rows:
        a, b = texts[r["doc_id"]].split(), texts[r["with_id"]].split()
        assert r["last_word"] - r["first_word"] >= 49 and r["similarity"] >= 0.8
        x, y = a[r["first_word"] : r["last_word"] + 1], b[r["with_first"] : r["with_last"] + 1]
        x, y = (set(zip(*(w[k:] for k in range(5)))) for w in (x, y))
        assert abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9


def test_passages_behind_fragments_and_lines(spark):
    """Two full copies at large ids, and at smaller ids fragments of them, or the lines they consist of."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(1_000_000)}"
    texts, full = {}, []

    def put(inner):
        texts[len(texts) + 1] = " ".join([word() for _ in range(60)] + inner + [word() for _ in range(60)])

    for trial in range(120):
        if trial % 3 == 0:
            parts = [[word() for _ in range(20)] for _ in range(3)]
            fragments, passage = parts, sum(parts, [])
        elif trial % 3 == 1:
            parts = [[word() for _ in range(14)] for _ in range(4)]
            fragments, passage = parts, sum(parts, [])
        else:
            passage = [word() for _ in range(60)]
            fragments = [passage[:40], passage[20:], passage[:45]]
        for inner in fragments:
            put(inner)
        for _ in range(2):
            put(passage)
            full.append(len(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert named(compact_windows.repeated_passages(docs).collect()) == set(full)


def test_near_passages_behind_fragments(spark):
    """Two passages of 70 words that differ in one, at large ids, and fragments of them, too short to count, at smaller ones."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(1_000_000)}"
    texts, full = {}, []

    def put(inner):
        texts[len(texts) + 1] = " ".join([word() for _ in range(60)] + inner + [word() for _ in range(60)])

    for trial in range(100):
        passage = [word() for _ in range(70)]
        near = list(passage)
        near[rng.randrange(20, 50)] = word()
        for inner in (passage[:40], passage[15:58], passage[25:]) if trial % 2 else (near[:45], passage[20:62], near[30:]):
            put(inner)
        for inner in (passage, near):
            put(inner)
            full.append(len(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = named(compact_windows.repeated_passages(docs).collect())
    assert got <= set(full) and len(got) >= 0.94 * len(full)


@pytest.mark.parametrize("size", [40, 240])
def test_open_windows_are_compared_with_their_whole_group(size, monkeypatch):
    """Every open row that any other row confirms is in a pair, in small groups and through lists of rare tokens."""
    monkeypatch.setattr(compact_windows, "ALL_PAIRS", 100)
    rng = np.random.default_rng(size)
    middle, width = compact_windows.REACH, compact_windows.AROUND
    shared = rng.integers(1, 1 << 32, (size // 8, width), dtype=np.uint32)
    line = rng.integers(1, 1 << 32, 21, dtype=np.uint32)
    codes = rng.integers(1, 1 << 32, (size, width), dtype=np.uint32)
    for k in range(size):
        kind, low = k % 4, int(rng.integers(0, middle + 1))
        if kind:  # one passage, a fragment of it, or all that is around; some with a change
            length = (0, compact_windows.TOKENS + k % 7, 30 + k % 9, width)[kind]
            codes[k, low : low + length] = shared[k % len(shared), low : low + length]
            if k % 3 == 0:
                codes[k, low + 9 : low + 14] = rng.integers(1, 1 << 32, 5, dtype=np.uint32)
        if k % 5 == 0:
            codes[k, : k % middle] = 0  # beyond the document
        codes[k, middle : middle + 21] = line if not kind else codes[k, middle : middle + 21]
        codes[k, middle] = 7
    docs = np.arange(size) // 2
    is_open = rng.random(size) < 0.8

    def confirmed(x, y):
        (ta, ca), (tb, cb) = ((r[r > 0], int((r[:middle] > 0).sum())) for r in (codes[min(x, y)], codes[max(x, y)]))
        return docs[x] != docs[y] and bool(compact_windows.verify_around(ta, tb, ca, cb))

    want = {x for x in range(size) if is_open[x] and any(confirmed(x, y) for y in range(size))}
    stay, hit = compact_windows.plausible(np.full(size, 5), codes)
    reach = np.full(len(hit), middle)
    assert compact_windows.unserved(hit, np.zeros_like(hit), reach, reach).all()
    assert not compact_windows.unserved(hit, np.ones_like(hit), reach, reach).any()
    assert not compact_windows.unserved(hit, np.zeros_like(hit), reach // 2, reach // 2).any()
    pairs = [(int(stay[x]), int(stay[y])) for x, y in compact_windows.compared(codes[stay], docs[stay], docs[stay], is_open[stay])]
    assert all(confirmed(x, y) for x, y in pairs) and len(pairs) <= size and (size < 100 or len(stay) > compact_windows.ALL_PAIRS)
    assert {x for x in sum(pairs, ()) if is_open[x]} == want and size // 4 < len(want) < size


def test_pairs_of_classes_are_those_of_different_documents(spark):
    """Classes of one signature, in groups that reach over batches; of equal documents another one is taken."""
    rng = np.random.default_rng(8)
    one, near, rows = rng.integers(1, 1 << 31, compact_windows.AROUND, dtype=np.uint32), None, []
    near = one.copy()
    near[60:65] += np.uint32(1)
    for sig in range(3000):
        doc, other = ((1, 9), (1, 1), (2, 2))[sig % 3]
        rows += [(sig, 1, 50, 45, 45, True, 1, 50, one.tobytes()), (sig, doc, 70, 45, 45, False, other, 70, near.tobytes())]
    classes = spark.createDataFrame(rows, "sig bigint, doc_id bigint, at bigint, before bigint, after bigint, open boolean, z_id bigint, z_at bigint, codes binary")
    got = compact_windows.group_pairs(classes).groupBy("a", "b", "ca", "cb").count().collect()
    assert sorted(map(tuple, got)) == [(1, 2, 50, 70, 1000), (1, 9, 50, 70, 1000)]


def test_pairs_never_looked_at_meet_in_the_second_round(spark):
    """Documents 2 and 3 share token and left half; the head of their group reaches too few tokens."""
    place = lambda at, before, after, left: at << 36 | before << 28 | after << 22 | left << 11
    rows = [(5, 1, place(9, 9, 8, 0), 1), (5, 2, place(40, 40, 20, 7), 1), (5, 3, place(60, 45, 30, 7), 1), (5, 4, place(60, 45, 30, 8), 1)]
    shared = spark.createDataFrame(rows, "sig bigint, doc_id bigint, place bigint, a bigint")
    found = spark.createDataFrame([], "doc_id bigint, with_id bigint, first_word bigint, last_word bigint, with_first bigint, with_last bigint")
    assert compact_windows.star_candidates(shared).count() == 0
    assert [tuple(r) for r in compact_windows.neighbours(shared, found).collect()] == [(2, 3, 40, 60)]


def test_one_shared_minimum_makes_a_candidate(spark):
    """Documents 1 and 2 meet under the second hash function only, and neither half window has an equal minimum."""
    place = lambda at, left, right: at << 36 | 1 << 34 | 30 << 28 | 30 << 22 | left << 11 | right
    rows = [(5, 1, place(40, 3, 4), 1), (5, 2, place(70, 5, 6), 1)]
    shared = spark.createDataFrame(rows, "sig bigint, doc_id bigint, place bigint, a bigint")
    assert [(r.a, r.b, [tuple(x) for x in r.starts]) for r in compact_windows.star_candidates(shared).collect()] == [(1, 2, [(70, 40)])]


def test_signatures_are_counted_without_places(spark, odd):
    """Counting needs no places: the same rows come without them, and without the work for half windows."""
    whole = compact_windows.signatures(odd).select("sig", "doc_id")
    plain = compact_windows.signatures(odd, places=False)
    assert plain.columns == ["sig", "doc_id"] and plain.count() == whole.count() > 0
    assert plain.exceptAll(whole).count() == 0


def test_lists_of_a_column():
    import pyarrow as pa

    column = pa.array([[{"x": 1, "y": 2}, {"x": 3, "y": 4}], None, [], [{"x": 5, "y": 6}]])
    bounds, x, y = compact_windows.lists_of(column.slice(1), "x", "y")
    assert bounds.tolist() == [0, 0, 0, 1] and (x.tolist(), y.tolist()) == ([5], [6])
    bounds, x, y = compact_windows.lists_of(column, "x", "y")
    assert bounds.tolist() == [0, 2, 2, 2, 3] and (x.tolist(), y.tolist()) == ([1, 3, 5], [2, 4, 6])


def test_near_passages_with_scattered_changes(spark):
    """Two of 100 words differ, so 86 of 106 shingles are shared."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(1_000_000)}"
    texts, pairs = {}, set()
    for k in range(150):
        one = [word() for _ in range(100)]
        other = list(one)
        other[33], other[66] = word(), word()
        for n, inner in ((2 * k, one), (2 * k + 1, other)):
            texts[n] = " ".join([word() for _ in range(40)] + inner + [word() for _ in range(40)])
        pairs.add((2 * k + 1, 2 * k))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {(r.doc_id, r.with_id) for r in compact_windows.repeated_passages(docs).select("doc_id", "with_id").collect()}
    assert got <= pairs and len(got) >= 0.97 * len(pairs)


def test_only_promising_pairs_get_both_texts(spark):
    """Short stretches around the starts tell which pairs may hold a passage; all that ``verify`` confirms stay."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(1_000_000)}"
    texts, starts, confirmed = {}, [], set()
    for k in range(40):
        line, passage = [word() for _ in range(40)], [word() for _ in range(51 + k)]
        near = list(passage)
        near[k] = word()
        for n, (before, inner, after) in enumerate((
            (0, passage, 30), (k % 3, passage, 0), (k, near, 40), (300, line, 300), (200, line, 200),
        ), 10 * k):
            texts[n] = " ".join([word() for _ in range(before)] + inner + [word() for _ in range(after)])
        for a, b in ((0, 1), (0, 2), (1, 2), (3, 4)):
            one, two = (compact_windows.tokens_of(x, np.array([0, len(x)]))[0] for x in (
                np.frombuffer(texts[10 * k + i].encode(), np.uint8) for i in (a, b)))
            both = [(int(np.flatnonzero(one == t)[0]), cb) for cb, t in enumerate(two.tolist()) if t in set(one.tolist())]
            for chosen in ([both[0]], [both[-1]], both[::10]):
                row = (10 * k + a, 10 * k + b, [(cb, ca) for ca, cb in chosen])
                starts.append(row)
                if compact_windows.verify(one, two, sorted(chosen, key=lambda x: x[::-1]))[0]:
                    confirmed.add((row[0], row[1], tuple(row[2])))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    pairs = spark.createDataFrame(starts, "a bigint, b bigint, starts array<struct<cb:bigint,ca:bigint>>")
    sent = compact_windows.contexts(pairs, docs)
    assert "string" not in dict(sent.dtypes).values()
    assert all(len(r.codes) <= 91 for r in sent.collect() if len(r.starts) == 1)
    stay = {(r.a, r.b, tuple(tuple(x) for x in r.starts)) for r in compact_windows.promising(pairs, docs).collect()}
    assert confirmed <= stay and len(confirmed) > 200
    assert not any(a % 10 == 3 for a, _, _ in stay)


@pytest.mark.parametrize("penalty", [4, 8])
def test_best_runs(penalty):
    rng = np.random.default_rng(penalty)
    for n in (1, 2, 30):
        hit = rng.random(n) < 0.8
        score = np.where(hit, 1, -penalty)
        first, last = compact_windows.best_runs(hit, penalty)
        for at in range(n):
            left = {j: score[j : at + 1].sum() for j in range(at + 1)}
            right = {j: score[at : j + 1].sum() for j in range(at, n)}
            assert first[at] == min(j for j in left if left[j] == max(left.values()))
            assert last[at] == max(j for j in right if right[j] == max(right.values()))


def test_repeated_passages_of_odd_rows(odd, none):
    assert named(compact_windows.repeated_passages(odd).collect()) == {5, 6, 7, 11, 12}
    assert compact_windows.repeated_passages(none).count() == 0


# --- templates ---------------------------------------------------------------------------------

ITEMS = [
    (1, "Anna has 12 apples and buys 7 more apples for 3 dollars each, so how many apples does Anna have now?"),
    (2, "Paul has 12 apples and buys 7 more apples for 3 dollars each, so how many apples does Paul have now?"),
    (3, "The train leaves the old station at 9 and reaches the far coast after 240 km of slow and quiet travel."),
    (4, "too short"), (5, None), (6, ""),
]
FILL = "some words that nobody has put into any question before and that go on for a while "


def test_templates(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    cases = {
        1: FILL + ITEMS[0][1] + " " + FILL,
        2: FILL + ITEMS[0][1].replace("Anna", "Bert").replace("12", "19").replace("7", "40") + " " + FILL,
        3: FILL + ITEMS[0][1].replace("Anna has", "Cora has").replace("Anna have", "Dora have").replace("12", "8").replace("7", "8") + FILL,
        4: FILL * 3, 5: None, 6: "", 7: "too short",
        8: FILL + ITEMS[2][1].replace("240 km", "three hundred miles").replace("9", "ten") + FILL,
        9: FILL + ITEMS[2][1][:40] + " " + FILL,
        10: "Anna has 3 pears. " * 50,
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in template_leaks.contaminated(docs, bench).collect()}
    assert {k for k in got if k[0] != 3} == {(1, 1), (2, 1), (8, 3)} - ({(8, 3)} - set(got))
    assert got[1, 1]["exact"] and not got[2, 1]["exact"] and got[1, 1]["n_items"] == 2
    assert template_leaks.clean(docs, bench).filter("doc_id IN (1, 2)").count() == 0
    assert template_leaks.contaminated(docs, bench.limit(0)).count() == 0


def test_leaks_of_all_documents(spark, texts):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    want = {(i, b["item_id"]) for i, r in texts.items() for b in bench if r["text"] and b["text"] in r["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_template_leaks(spark, FOLDER).collect()}
    assert got == want


RUNS = [
    "Who among the many guests that came there were Anna Brown, Carl Davis, Emma Fox and Greg Hall who left early that night?",
    "Please explain how to continue the series 2, 4, 8, 16, 32, 64, 128 and why the rule must hold for ever.",
    "Find the mean of the values 3 7 9 12 15 18 21 24 30 33 and then say which of them lies closest to it.",
    "We met Ann Bo Cy Di Ed Flo near the river and walked on to the old mill with them.",
    "Add the words one two three four five six seven eight and compare the sum with that of the other row.",
]


def test_exact_copies_of_runs_of_slots(spark):
    bench = spark.createDataFrame(list(enumerate(RUNS)), "item_id bigint, text string")
    places = [(k, shift) for k in range(len(RUNS)) for shift in range(16)]
    docs = [(n, "so " * shift + RUNS[k] + " " + FILL) for n, (k, shift) in enumerate(places)]
    got = template_leaks.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(n, k) for n, (k, _) in enumerate(places)}
    assert all(r["exact"] for r in got)


def test_copies_in_other_case(spark):
    texts = [ITEMS[0][1], ITEMS[2][1], *RUNS, "Lo Que Ñandú y Élan miden en Madrid, Sevilla y Cádiz es 12 veces lo que Ana Ruiz vio."]
    texts.append(texts[0].replace("Anna", "Zoe"))  # not the item that names its class
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = [(3 * k + n, f"{FILL}{of(x)} {FILL}") for k, x in enumerate(texts) for n, of in enumerate((str.lower, str.upper, str.title))]
    got = template_leaks.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    named_by = {len(texts) - 1: 0}
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, named_by.get(d // 3, d // 3)) for d, _ in docs}


def test_edited_and_partial_copies(spark):
    item = ITEMS[2][1]
    words = item.split()
    rng = random.Random(3)
    long = [f"x{rng.randrange(10**6)}y" for _ in range(59)]
    cases = [" ".join([*words[:k], "other", *words[k + 1 :]]) for k in range(1, len(words) - 1)]
    cases += [" ".join([*words[:k], "other", *words[k:]]) for k in range(1, len(words))]
    cases += [" ".join([*words[:k], *words[k + 1 :]]) for k in range(1, len(words) - 1)]
    cases += [ITEMS[0][1].replace("Anna", "Mary Ann"), " ".join(long[:40]), " ".join(long[10:50])]
    want = [3] * (len(cases) - 3) + [1, 7, 7]
    bench = spark.createDataFrame([ITEMS[0], ITEMS[2], (7, " ".join(long))], "item_id bigint, text string")
    docs = [(n, f"{FILL}{x} {FILL}") for n, x in enumerate(cases)]
    docs += [(1000, FILL + " ".join(long[:20]) + " " + FILL), (1001, FILL + " ".join(words[:9]) + " " + FILL)]
    got = template_leaks.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(enumerate(want))


def test_runs_of_numbers_make_no_pairs(spark):
    """Documents and items that have nothing but numbers in a row in common do not meet, copies do."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(1_000_000)}"
    number = lambda: str(rng.randrange(1000))
    items = [(k, " ".join([word() for _ in range(9)] + [number() for _ in range(7)] + [word() for _ in range(3)])) for k in range(1, 101)]
    docs = [(k, " ".join([word() for _ in range(20)] + [number() for _ in range(40)] + [word() for _ in range(20)])) for k in range(1, 101)]
    docs += [(500 + k, f"{word()} {word()} {items[k][1]} {word()}") for k in range(5)]
    only = [(900, "2 4 8 16 32 64 128"), (901, " ".join([word() for _ in range(6)]) + " 2 4 8 16 32 64 128 " + word())]
    bench = spark.createDataFrame([*items, only[0]], "item_id bigint, text string")
    docs = spark.createDataFrame([*docs, only[1]], "doc_id bigint, text string")
    found = template_leaks.near_items(docs, template_leaks.template_items(bench))
    assert found.select("doc_id", "variant").distinct().filter("doc_id < 900").groupBy("variant").count().filter("count > 1").count() == 1
    got = {(r["doc_id"], r["item_id"]) for r in template_leaks.contaminated(docs, bench).collect()}
    assert {(500 + k, k + 1) for k in range(5)} | {(901, 900)} <= got and {i for _, i in got} == {1, 2, 3, 4, 5, 900}


def test_long_items_are_aligned_in_a_band():
    """One word of 1,500 changed is seen, an item of 20,000 words is held, with a part put in between."""
    rng = np.random.default_rng(5)
    for n in (1_500, 20_000):
        item = rng.integers(1, 1 << 62, n).astype(np.uint64)
        doc = np.concatenate((rng.integers(1, 1 << 62, 100).astype(np.uint64), item))
        doc[700] += np.uint64(1)
        doc = np.insert(doc, 900, rng.integers(1, 1 << 62, 30).astype(np.uint64))
        share, exact = template_leaks.held((item, item), (doc, doc), 130 // template_leaks.DRIFT)
        assert share == (n - 1) / n and exact
    same = np.zeros((40, 300), bool)
    same[5:34, 7] = True
    assert not template_leaks.verbatim(same)
    same[34, 7] = True
    assert template_leaks.verbatim(same)


def test_leaks_by_rate_of_edits(spark):
    """Items of 40 words, each word changed with a chance; below the coverage nothing is owed."""
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(1_000_000)}"
    items = [(k, " ".join(word() for _ in range(40))) for k in range(1, 61)]
    docs, owed = [], {}
    for rate in (0.02, 0.05, 0.1):
        for k, text in items:
            words = [word() if rng.random() < rate else w for w in text.split()]
            i = len(docs) + 1
            if sum(a == b for a, b in zip(words, text.split())) >= 32:
                owed.setdefault(rate, set()).add((i, k))
            docs.append((i, " ".join([word() for _ in range(10)] + words + [word() for _ in range(10)])))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in template_leaks.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got <= set().union(*owed.values())
    for rate, pairs in owed.items():
        assert len(pairs & got) >= 0.98 * len(pairs), (rate, len(pairs & got), len(pairs))


def test_leaks_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, brute.small("word0 said0 word1 said1 word2 said2 word3 said3"), "x")], "item_id bigint, text string, h string")
    found = template_leaks.contaminated(odd, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(5, 1), (None, 1)}
    stay = template_leaks.clean(odd, bench)
    assert stay.columns == odd.columns and stay.filter("doc_id = 5").count() == 0 and stay.filter("doc_id = 1").count() == 1
    assert template_leaks.clean(none, bench).count() == 0


# --- archives ----------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    big, rows = "page " * 300, []
    rows = [(1, "http://a/\r\nx", big), (2, None, big), (7, "http://b", big), (3, "http://c", "small"), (4, "u", "small"),
            (5, "u", None), (6, "u", ""), (None, "n", big), (None, "n", "only " * 400), (9, "é", "é" * 600), (8, "é", "é" * 600),
            (10, "t", "tie " * 400), (10, "t", "tie " * 400)]
    pages = spark.createDataFrame([(*r, "?") for r in rows], "page_id bigint, url string, html string, digest string")
    manifest = web_archives.write_archives(pages)
    assert sum(r["n_records"] for r in manifest.collect()) == len(rows)
    got = web_archives.read_archives(manifest).collect()
    last = {big: 7, "é" * 600: 9, "tie " * 400: 10}
    want = []
    for i, _, html in rows:
        ref = last.get(html or "")
        ref = None if ref == i else ref
        data = (html or "").encode()
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if ref is None else "revisit", ref, None if ref else data))
    key = lambda r: str(tuple(map(str, r)))
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    assert sorted((tuple(None if r[f] is None else (bytes(r[f]) if f == "payload" else r[f]) for f in fields) for r in got), key=key) == sorted(want, key=key)
    assert web_archives.read_archives(web_archives.write_archives(pages.limit(0))).count() == 0


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def zip64_package(content):
    """A package whose sizes and offsets stand in ZIP64 fields only."""
    name, none = b"archive/a.warc.gz", 0xFFFFFFFF
    extra = struct.pack("<HHQQ", 1, 16, len(content), len(content))
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, none, none, len(name), len(extra)) + name + extra
    wide = struct.pack("<HHHHI", 0x9999, 4, 0, 0, 0)[:8] + struct.pack("<HHQQQ", 1, 24, len(content), len(content), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, none, none, len(name), len(wide), 0, 0, 0, 0, none) + name + wide
    at = len(local) + len(content)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, none, none, 7) + b"comment"
    return local + content + central + end64 + locator + end


def test_zip64_directory():
    package = zip64_package(b"stored bytes")
    (member,) = web_archives.members(Bytes(package), len(package))
    assert (member.name, member.size, member.header) == ("archive/a.warc.gz", 12, 0)
    at = web_archives.data_offset(Bytes(package), member)
    assert package[at : at + 12] == b"stored bytes"


@pytest.mark.parametrize("data", [b"", b"PK", b"no archive at all" * 9])
def test_bad_packages(data):
    with pytest.raises(web_archives.BadArchive):
        web_archives.members(Bytes(data), len(data))


def test_compressed_members_are_refused():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", b"x" * 100)
    data = sink.getvalue()
    (member,) = web_archives.members(Bytes(data), len(data))
    with pytest.raises(web_archives.BadArchive):
        web_archives.data_offset(Bytes(data), member)


def test_package_without_index_is_walked(spark, tmp_path):
    import zlib

    rows = [{"page_id": k, "url": "u", "html": f"page {k} " * 50, "digest": hashlib.sha1((f"page {k} " * 50).encode()).hexdigest(), "refers_to": None} for k in range(5)]
    packs = []
    for row in rows:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        packs.append(pack.compress(web_archives.record_bytes(row, "2020-01-01T00:00:00Z")) + pack.flush())
    path = tmp_path / "own.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/own.warc.gz", b"".join(packs))
        z.writestr("readme.txt", b"hello")
    got = web_archives.read_archives(spark.createDataFrame([(str(path),)], "path string")).collect()
    assert sorted(r["page_id"] for r in got) == [0, 1, 2, 3, 4]


def test_file_systems(tmp_path):
    for path in (f"file:{tmp_path}", f"file://{tmp_path}", str(tmp_path)):
        fs, inner = file_system(path)
        assert inner == str(tmp_path) and fs.get_file_info(inner).is_file is False


def test_words_of_one_regular_pattern_are_no_copies(spark):
    a, b = "a", "b"
    while len(a) < 1024:
        a, b = a + b, b + a
    docs = spark.createDataFrame([(1, a), (2, b), (3, "q w e"), (4, b)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_components(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 2}
