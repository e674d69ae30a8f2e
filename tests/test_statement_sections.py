"""Sections per set of tables against a plain greedy choice over all sections."""

import random

import pytest

from workloom.operators import statement_sections as ss

SCHEMA = "doc bigint, line int, priority int, tokens bigint, affected_tables array<string>, code_blocks array<string>"


def drawn(seed, n=700):
    rnd = random.Random(seed)
    names = ["a.b.hot", "a.b.c", "x.y.z", "p.q.r"]
    return [(k // 5, k, rnd.choice([10, 20, 40]), rnd.choice([0, 1, 2, 3, 8, 30, 31, 90, 260]),
             sorted({"a.b.hot"} if rnd.random() < 0.5 else set(rnd.sample(names, rnd.randrange(3)))), ["x"] * rnd.randrange(2)) for k in range(n)]


def plain(rows, tables, budget):
    ranked = sorted((p - (15 if set(t) & set(tables) else 0) - (5 if code else 0), (d, k), p, size) for d, k, p, size, t, code in rows if size > 0)
    return sorted((*row, n) for row, n in ss.choose(ranked, budget))


def test_choice_skips_first_and_stops_second():
    ranked = [(1, "a", 10, 60), (2, "b", 10, 50), (3, "c", 10, 40), (4, "d", 20, 1), (5, "e", 40, 1)]
    assert ss.choose(ranked, 100) == [("a", 1), ("c", 1)]
    assert ss.choose(ranked, 102) == [("a", 1), ("c", 1)]  # b comes first in the second pass and does not fit
    assert ss.choose(ranked[3:], 1) == [("d", 2)]


@pytest.mark.parametrize(("seed", "budget"), [(1, 40), (2, 100), (3, 700)])
def test_equals_the_plain_choice(spark, seed, budget):
    rows = drawn(seed)
    sets = [([], 3), (["a.b.hot"], 2), (["a.b.c", "x.y.z"], 1), (["a.b.c", "a.b.hot", "p.q.r", "x.y.z"], 5), (["no.such.table"], 1)]
    got = ss.sections_for_statements(
        spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(sets, "tables array<string>, statements bigint"), ["doc", "line"], budget).collect()
    for tables, statements in sets:
        mine = [r for r in got if r["tables"] == tables]
        assert sorted((r["doc"], r["line"], r["pass"]) for r in mine) == plain(rows, tables, budget)
        assert {r["statements"] for r in mine} == {statements}


def test_lists_are_short_whatever_the_table(spark):
    rows = [(k, k, 10 if k % 2 else 40, 50, ["a.b.hot"], []) for k in range(5000)]
    scored = ss.scored_sections(spark.createDataFrame(rows, SCHEMA), ["doc", "line"])
    assert ss.within_reach(ss.index_by_table(scored, ["doc", "line"]), "table_name", ["doc", "line"], 500).count() <= 40


def test_nothing_to_choose(spark):
    empty = spark.createDataFrame([], SCHEMA)
    sets = spark.createDataFrame([(["a"], 1)], "tables array<string>, statements bigint")
    assert ss.sections_for_statements(empty, sets, ["doc", "line"]).count() == 0
    full = spark.createDataFrame(drawn(4, 20), SCHEMA)
    assert ss.sections_for_statements(full, sets.limit(0), ["doc", "line"]).count() == 0
