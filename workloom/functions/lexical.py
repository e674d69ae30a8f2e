"""Lexical views of a statement, as Column expressions.

There is no parser here. A statement is turned into a few flat texts on which each rule is a
regular expression:

* ``tokens``: the text cut by one pattern into literals ('…' or "…", with doubled or
  backslashed quotes inside), identifiers in backticks, comments, and what stands between.
* ``parts``: per token the content of a literal.
* ``code``: the text without comments, blanks squeezed, each literal replaced by
  ``'class:index'`` (1 plain, 2 date-like, 3 holding a wildcard), so no rule reads into one.
  Backticks go; signs and blanks inside them become ``_``.
* ``marked``: the code with plain function calls and arithmetic parentheses inside ``⟨⟩``.
* ``segs``: one flat text per parenthesis left, innermost first, and the outermost text. A
  parenthesis inside a segment is shown as ``#``.
* ``scopes``: like ``segs``, but groups of conditions and window definitions stay in place, inside
  ``⟦⟧``: one text per SELECT, whose conditions and named windows stand in the clause they belong to.

Calls and parentheses are opened until nothing changes; the number of passes is bounded by the
number of parentheses of the statement itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_LIKE = r"^(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}.*)$"
LITERAL = r"'\d:\d+'"
NOT_CALLS = "IN|EXISTS|AS|ON|AND|OR|NOT|WHERE|FROM|JOIN|USING|OVER|VALUES|BY|SELECT|ANY|ALL|SOME|WHEN|THEN|UNION"
CLAUSE_END = (
    r"(?=\bWHERE\b|\bGROUP BY\b|\bHAVING\b|\bORDER BY\b|\bLIMIT\b|\bUNION\b|\bINTERSECT\b|\bEXCEPT\b"
    r"|\bWINDOW\b|\bQUALIFY\b|\bWHEN (?:NOT )?MATCHED\b|;|$)"
)
WINDOW_PARTS = "PARTITION BY|DISTRIBUTE BY|ORDER BY|SORT BY|CLUSTER BY|ROWS|RANGE|GROUPS"
OPERATOR = r"(<=|>=|<>|!=|=|<|>|\bNOT I?LIKE\b|\bI?LIKE\b|\bNOT IN\b|\bIN\b)"
IDENTIFIER = r"([A-Za-z_][\w.]*+)(?! ?⟨)"
TOKEN = (
    r"(?s)'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+(?:'|$)"
    r'|"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+(?:"|$)'
    r"|`[^`]*+(?:`|$)|--[^\n]*+|/\*.*?(?:\*/|$)|[^'\"`/-]++|."
)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def without_comments(text: Column) -> Column:
    """The statement with blanks for comments; literals and identifiers stay as they are."""
    return F.trim(F.array_join(F.transform(
        tokens(text), lambda t: F.when(t.rlike(r"^(--|/\*)"), " ").otherwise(t)), ""))


def text_key(text: Column) -> Column:
    """A digest under which all statements meet that differ in comments only."""
    return F.sha2(without_comments(text), 256)


def literal_parts(pieces: Column) -> Column:
    """The content of each token that is a literal."""
    return F.transform(pieces, lambda t: F.when(
        t.rlike("^['\"]") & (F.length(t) > 1), F.regexp_replace(t, r"^['\"]|['\"]$", "")))


def masked_code(pieces: Column) -> Column:
    def shown(token: Column, i: Column) -> Column:
        part = F.regexp_replace(token, r"^['\"]|['\"]$", "")
        kind = (
            F.when(part.rlike(DATE_LIKE), "2")
            .when(F.contains(part, F.lit("%")) | F.contains(part, F.lit("_")), "3").otherwise("1")
        )
        return (
            F.when(token.rlike("^['\"]"), F.when(
                F.length(token) > 1, F.concat(F.lit("'"), kind, F.lit(":"), i.cast("string"), F.lit("'"))).otherwise(" "))
            .when(token.rlike(r"^(--|/\*)"), " ")
            .when(token.startswith("`"), F.regexp_replace(F.translate(token, "`", ""), r"\W+", "_"))
            .otherwise(token)
        )

    return F.trim(F.regexp_replace(F.array_join(F.transform(pieces, shown), ""), r"\s+", " "))


def settled(start: Column, bound: Column, step) -> Column:
    """Apply ``step`` to a value until it no longer changes, ``bound`` times at most."""
    state = F.struct(start.alias("x"), F.lit(False).alias("done"))

    def turn(acc: Column, _: Column) -> Column:
        moved = F.transform(F.array(step(acc["x"])), lambda y: F.struct(y.alias("x"), (y == acc["x"]).alias("done")))
        return F.when(acc["done"], acc).otherwise(F.get(moved, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(bound, F.lit(1))), state, turn, lambda acc: acc["x"])


def how_many(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.translate(text, sign, ""))


def restored(text: Column, parts: Column) -> Column:
    """Put literals and call parentheses back into a piece of masked code."""
    filled = F.array_join(F.transform(
        F.split(text, "'"),
        lambda p, i: F.when(i % 2 == 1, F.get(parts, F.split(p, ":")[1].try_cast("int"))).otherwise(p),
    ), "'")
    return F.trim(F.translate(filled, "⟨⟩", "()"))


def literal_value(masked: Column, parts: Column) -> Column:
    return F.get(parts, F.regexp_extract(masked, r"'\d:(\d+)'", 1).try_cast("int"))


def calls_marked(code: Column) -> Column:
    """COUNT(DISTINCT c) as one token, plain calls and arithmetic parentheses inside ⟨⟩."""
    out = F.regexp_replace(code, r"(?i)\bCOUNT ?\( ?DISTINCT ([\w.]+)[^()]*\)", "COUNTDISTINCT:$1")
    out = F.regexp_replace(out, r"(?i)\bCOUNT ?\( ?DISTINCT (\w+) ?\(([^()]*)\)[^()]*\)", "COUNTDISTINCT:$1⟨$2⟩")

    def one_pass(text: Column) -> Column:
        calls = F.regexp_replace(
            text, rf"(?i)\b(?!(?:{NOT_CALLS})\b)(\w++) ?\((?![^()]*\bSELECT\b)([^()]*+)\)", "$1⟨$2⟩"
        )
        return F.regexp_replace(
            calls, r"(?i)([=<>+*/%,(-]|\bWHERE|\bAND|\bOR|\bON) ?\((?![^()]*\b(?:SELECT|AND|OR)\b)([^(),]*+)\)",
            "$1 ⟨$2⟩",
        )

    return settled(out, how_many(code, "("), one_pass)


def segments(marked: Column) -> Column:
    """Innermost parentheses first, each with the word before it; the outermost text last."""
    inner = r"(\b\w++ ?)?+\([^()]*+\)"
    start = F.struct(marked.alias("text"), F.array().cast("array<string>").alias("found"))
    opened = settled(start, how_many(marked, "("), lambda x: F.struct(
        F.regexp_replace(x["text"], inner, "$1#").alias("text"),
        F.concat(x["found"], F.regexp_extract_all(x["text"], F.lit(inner), F.lit(0))).alias("found"),
    ))
    return F.transform(F.array(opened), lambda x: F.concat(x["found"], F.array(x["text"])))[0]


def scopes_marked(marked: Column) -> Column:
    """Groups of conditions and window definitions inside ⟦⟧, and OVER (w …) as OVER w."""
    group = r"(?i)(\b(?:WHERE|AND|OR|NOT|ON|HAVING|WHEN|THEN|ELSE|CASE)|[(⟦]) ?\((?![^()]*\bSELECT\b)([^()]*+)\)"
    definition = rf"(?i)\b(AS) ?\((?=\)|\w+ ?\)|(?:\w+ )?(?:{WINDOW_PARTS})\b)([^()]*+)\)"
    named = F.regexp_replace(marked, rf"(?i)\b(OVER) ?\((?!(?:{WINDOW_PARTS})\b)(\w+)[^()]*+\)", "$1 $2")
    placed = settled(named, how_many(named, "("), lambda t: F.regexp_replace(
        F.regexp_replace(t, group, "$1 ⟦$2⟧"), definition, "$1 ⟦$2⟧"))
    # Most statements have none of these, and keep their text.
    return F.when(marked.rlike(r"(?i)(?:\b(?:WHERE|AND|OR|NOT|WHEN|THEN|ELSE|CASE) ?|[(])\(|\bWINDOW\b"), placed).otherwise(marked)


def scopes(marked: Column) -> Column:
    """One text per SELECT: the segments of the marked scopes, cut at set operators."""
    return F.filter(F.flatten(F.transform(segments(scopes_marked(marked)), lambda s: F.split(
        s, r"(?i)\b(?:UNION|INTERSECT|EXCEPT|MINUS)\b(?: (?:ALL|DISTINCT)\b)?"))), lambda s: s != "")


def window_uses(scope: Column) -> Column:
    """(before, name, known, divided) per OVER name of a scope: the text in front, whether the scope
    defines the window, and whether its definition, or the one that it builds on, has partitions."""
    clause = F.regexp_extract(scope, r"(?i)\bWINDOW (\w+ AS\b.*)$", 1)
    defined = F.transform(
        F.regexp_extract_all(clause, F.lit(r"(?i)\w+ AS (?:⟦[^⟦⟧]*⟧|\w+)"), F.lit(0)),
        lambda d: F.struct(
            F.lower(F.regexp_extract(d, r"^(\w+)", 1)).alias("name"),
            F.lower(F.regexp_extract(d, r"(?i)^\w+ AS ⟦? ?(\w+)", 1)).alias("base"),
            d.rlike(r"(?i)\b(?:PARTITION|DISTRIBUTE) BY\b").alias("divided")))
    start = F.transform(F.filter(defined, lambda d: d["divided"]), lambda d: d["name"])
    divided = settled(start, F.size(defined), lambda names: F.array_distinct(F.concat(names, F.transform(
        F.filter(defined, lambda d: F.array_contains(names, d["base"])), lambda d: d["name"]))))
    pieces = F.split(scope, r"(?i)\bOVER (?=\w)")
    name = lambda k: F.lower(F.regexp_extract(F.get(pieces, k), r"^(\w+)", 1))
    uses = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda before, k: F.struct(
        before.alias("before"), name(k + 1).alias("name"),
        F.exists(defined, lambda d: d["name"] == name(k + 1)).alias("known"),
        F.array_contains(divided, name(k + 1)).alias("divided")))
    return uses


def heads(segs: Column) -> Column:
    """Each segment's text up to its first inner parenthesis, which stands as it is in ``marked``."""
    return F.transform(segs, lambda s: F.struct(F.substring_index(s, "#", 1).alias("head"), s.alias("seg")))


def texts_before(marked: Column, head: Column) -> Column:
    """The text before every place where a head stands."""
    pieces = F.split(marked, F.concat(F.lit("\\Q"), head, F.lit("\\E")))
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def slices(segs: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern in all segments."""
    return F.flatten(F.transform(segs, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(group))))


def where_slices(segs: Column) -> Column:
    tail = CLAUSE_END.replace(r"\bWHERE\b|", "")
    return slices(segs, r"(?i)\bWHERE\b(.*?)" + tail)


def from_slices(segs: Column) -> Column:
    return slices(segs, r"(?i)\bFROM\b(.*?)" + CLAUSE_END)


def predicates(wheres: Column) -> Column:
    """WHERE slices cut at AND and OR, at groups and at the branches of CASE."""
    cut = r"(?i)\b(?:AND|OR|CASE|WHEN|THEN|ELSE|END)\b|[⟦⟧]"
    return F.filter(
        F.transform(F.flatten(F.transform(wheres, lambda w: F.split(w, cut))), lambda x: F.trim(x)),
        lambda p: p != "",
    )


def left_side(predicate: Column) -> Column:
    return F.regexp_extract(predicate, r"(?i)^(?:NOT )?(.*?) ?" + OPERATOR, 1)


def bare_name(dotted: Column) -> Column:
    return F.substring_index(dotted, ".", -1)


def comma_items(text: Column) -> Column:
    """Items of a list; commas inside a call do not count."""
    return F.transform(F.split(text, r",(?![^⟨⟩]*⟩)"), lambda x: F.trim(x))


def from_items(froms: Column) -> Column:
    """Table items of FROM slices: cut at commas and joins, ON conditions dropped."""
    cut = F.flatten(F.transform(froms, lambda f: F.split(f, r"(?i),|\b(?:NATURAL |LEFT |RIGHT |FULL |INNER |CROSS |OUTER |SEMI |ANTI )*JOIN\b")))
    return F.filter(
        F.transform(cut, lambda t: F.trim(F.regexp_replace(t, r"(?i)\b(?:ON|USING)\b.*$", ""))),
        lambda t: t.rlike(r"^[A-Za-z_`]"),
    )


def table_names(code: Column, segs: Column) -> Column:
    """Names after FROM, JOIN, INTO, USING and in comma lists, as written, without CTE names."""
    named = F.regexp_extract_all(code, F.lit(r"(?i)\b(?:FROM|JOIN|INTO|USING|UPDATE) ([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)"), F.lit(1))
    listed = F.transform(from_items(from_slices(segs)), lambda t: F.regexp_extract(t, r"^([A-Za-z_][\w.]*)", 1))
    ctes = F.regexp_extract_all(code, F.lit(r"(?i)(?:\bWITH|,) (?:RECURSIVE )?(\w+) AS \("), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(F.concat(named, listed)), ctes))


def full_table_refs(names: Column) -> Column:
    """Three-part names kept, two-part names under ``main``, one-part names dropped."""
    parts = lambda t: F.size(F.split(t, r"\."))
    full = F.transform(names, lambda t: F.when(parts(t) == 2, F.concat(F.lit("main."), t)).when(parts(t) == 3, t))
    return F.array_sort(F.array_distinct(F.array_compact(full)))
