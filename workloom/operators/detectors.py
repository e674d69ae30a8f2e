"""Anti-pattern rules over a whole statement corpus, in one pass and without a shuffle.

Each rule is a function from the lexical columns of a statement to an array of findings.
Distinct texts are analysed once and the findings are joined back to the statements.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workloom.functions import lexical as lx
from workloom.functions.text import statement_hash

# Functions that hide a column from pruning when they stand left of a comparison.
WRAPPING_FUNCTIONS = (
    "YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DATE", "DATE_TRUNC", "TIMESTAMP_TRUNC", "TO_DATE",
    "EXTRACT", "DAYOFWEEK", "DAYOFMONTH", "DAYOFYEAR", "WEEKOFYEAR", "QUARTER", "LAST_DAY", "NEXT_DAY",
    "DATE_FORMAT", "FROM_UNIXTIME", "UNIX_TIMESTAMP", "TO_TIMESTAMP", "UPPER", "LOWER", "TRIM", "LTRIM",
    "RTRIM", "SUBSTRING", "SUBSTR", "LEFT", "RIGHT", "CONCAT", "CONCAT_WS", "LENGTH", "CHAR_LENGTH", "REPLACE",
    "TRANSLATE", "REVERSE", "REPEAT", "LPAD", "RPAD", "SPLIT", "REGEXP_EXTRACT", "CAST", "CONVERT", "TRY_CAST",
    "ABS", "ROUND", "FLOOR", "CEIL", "CEILING", "SQRT", "POWER", "POW", "EXP", "LN", "LOG", "SIN", "COS", "TAN",
    "ASIN", "ACOS", "ATAN", "COALESCE", "NVL", "IFNULL", "NULLIF",
)

# Name parts that suggest many or few distinct values.
HIGH_NAMES = (
    "id", "uid", "uuid", "guid", "user_id", "session_id", "transaction_id", "order_id", "request_id", "event_id",
    "customer_id", "product_id", "account_id", "device_id", "timestamp", "datetime", "created_at", "updated_at",
    "email", "phone", "ip", "ip_address", "mac_address",
)
LOW_NAMES = (
    "country", "region", "state", "city", "country_code", "status", "type", "category", "class", "level", "flag",
    "enabled", "active", "is_", "has_", "gender", "role", "tier", "plan", "priority", "year", "month", "day",
    "quarter", "week",
)

# Endings of column names that are taken as unique.
UNIQUE_NAMES = (
    "id", "uuid", "guid", "user_id", "customer_id", "account_id", "order_id", "transaction_id", "session_id",
    "request_id", "event_id", "product_id", "item_id", "device_id", "merchant_id", "invoice_id", "payment_id",
    "subscription_id",
)

# Type classes by name part of the column, in the order of the checks.
STRING_NAMES = ("phone", "zip", "postal", "ssn", "code", "name", "email", "address", "description")
NUMBER_NAMES = ("_id", "count", "quantity", "amount", "price", "total")
TIME_NAMES = ("date", "time", "timestamp")

# Type classes by declared type, first contained name wins.
TYPE_CLASSES = (
    ("VARCHAR", "string"), ("CHAR", "string"), ("STRING", "string"), ("TEXT", "string"), ("INT", "numeric"),
    ("INTEGER", "numeric"), ("BIGINT", "numeric"), ("SMALLINT", "numeric"), ("TINYINT", "numeric"),
    ("DECIMAL", "numeric"), ("NUMERIC", "numeric"), ("FLOAT", "numeric"), ("DOUBLE", "numeric"), ("REAL", "numeric"),
    ("DATE", "datetime"), ("TIMESTAMP", "datetime"), ("DATETIME", "datetime"), ("BOOLEAN", "boolean"), ("BOOL", "boolean"),
)
AGGREGATES = "COUNT|SUM|AVG|MIN|MAX|STDDEV|VARIANCE|COLLECT_LIST|COLLECT_SET|APPROX_COUNT_DISTINCT"

FINDING = "struct<severity:string,message:string,context:map<string,string>,fix:string>"


def finding(severity, message: Column, fix: Column, **context: Column) -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    pairs = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        severity.alias("severity"), message.alias("message"),
        F.create_map(*pairs).alias("context"), fix.alias("fix"),
    )


def says(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def listed(items: Column, sep: str = ", ") -> Column:
    return F.array_join(items, sep)


def prepared(statements: DataFrame, text: str = "statement_text") -> DataFrame:
    """Add the lexical columns that the rules read."""
    df = statements.withColumn("_tokens", lx.tokens(F.col(text)))
    df = df.withColumns({"parts": lx.literal_parts(F.col("_tokens")), "code": lx.masked_code(F.col("_tokens"))}).drop("_tokens")
    df = df.withColumn("marked", lx.calls_marked(F.col("code")))
    df = df.withColumn("segs", lx.segments(F.col("marked")))
    df = df.withColumn("scopes", lx.scopes(F.col("marked")))
    df = df.withColumns({"wheres": lx.where_slices(F.col("scopes")), "froms": lx.from_slices(F.col("segs"))})
    return df.withColumns({
        "preds": lx.predicates(F.col("wheres")),
        "tables": lx.table_names(F.col("code"), F.col("segs")),
    })


class _Statement:
    """The lexical columns by name; built on access, since a Column needs a live session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


S = _Statement()


def _any_in(name: Column, words: tuple[str, ...]) -> Column:
    return name.rlike("|".join(words))


# --- the rules -------------------------------------------------------------------------------

def non_sargable() -> Column:
    names = "|".join(WRAPPING_FUNCTIONS)
    function = lambda left: F.upper(F.regexp_extract(left, rf"(?i)\b({names}) ?⟨.*?[A-Za-z_]", 1))
    inside = lambda left: F.regexp_extract(left, rf"(?i)\b(?:{names}) ?⟨(.*)$", 1)

    def fix_for(fn: Column, column: Column) -> Column:
        return (
            F.when(fn.isin("YEAR", "MONTH", "DAY", "DATE_TRUNC", "EXTRACT"),
                   says("Use a half-open range: ", column, " >= start AND ", column, " < end"))
            .when(fn.isin("UPPER", "LOWER"), says("Store ", column, " in one case and compare it directly"))
            .when(fn.isin("TRIM", "LTRIM", "RTRIM"), says("Store ", column, " trimmed and compare it directly"))
            .when(fn.isin("SUBSTRING", "SUBSTR", "LEFT", "RIGHT"), says("Use ", column, " LIKE 'prefix%' or a range"))
            .when(fn.isin("CAST", "CONVERT", "TRY_CAST"), says("Cast the literal to the type of ", column))
            .when(fn.isin("ABS", "ROUND", "FLOOR", "CEIL", "CEILING"), says("Use bounds: ", column, " BETWEEN low AND high"))
            .otherwise(says("Move ", fn, " from ", column, " to the literal or to a stored column"))
        )

    def arithmetic_fix(op: Column, column: Column) -> Column:
        inverse = F.when(op == "Mul", "divide").when(op == "Div", "multiply").when(op == "Add", "subtract from").otherwise("add to")
        return F.when(op == "Mod", says("Store the remainder of ", column, " as its own column")).otherwise(
            says("Leave ", column, " alone and ", inverse, " the literal instead")
        )

    def check(pred: Column) -> Column:
        left = lx.left_side(pred)
        fn = function(left)
        fn = F.when(fn == "TIMESTAMP_TRUNC", "DATE_TRUNC").otherwise(fn)
        args = inside(left)
        col_in = lx.bare_name(F.coalesce(
            F.nullif(F.regexp_extract(args, r"(?i)\bFROM ([\w.]+)", 1), F.lit("")),
            F.regexp_extract(args, lx.IDENTIFIER, 1),
        ))
        sign_of = lambda t: F.nullif(F.regexp_extract(t, r"[\w.⟩'#] ?([*/+%-]) ?[\w.⟨'#-]", 1), F.lit(""))
        sign = F.coalesce(
            sign_of(F.regexp_replace(left, r"\w* ?⟨[^⟨⟩]*⟩", "#")),
            sign_of(F.regexp_replace(left, r"\w+ ?⟨[^⟨⟩]*⟩", "#")),
        )
        op = F.when(sign == "*", "Mul").when(sign == "/", "Div").when(sign == "+", "Add").when(sign == "-", "Sub").when(sign == "%", "Mod")
        col_left = lx.bare_name(F.regexp_extract(F.regexp_replace(left, lx.LITERAL, "0"), lx.IDENTIFIER, 1))
        shown = lx.restored(pred, S.parts)
        return (
            F.when((fn != "") & (col_in != ""), finding(
                "high", says("Filter wraps ", col_in, " in ", fn, "(): no pruning on that column"), fix_for(fn, col_in),
                function=fn, column=col_in, predicate=shown))
            .when(op.isNotNull() & (col_left != ""), finding(
                "high", says("Filter computes on ", col_left, ": no pruning on that column"), arithmetic_fix(op, col_left),
                operation=op, column=col_left, predicate=shown))
        )

    return F.array_compact(F.transform(S.preds, check))


def select_star() -> Column:
    star = r"(?i)\bSELECT (?:(?:DISTINCT|ALL) )?(?:[^()]*?, ?)?\*(?= ?,| FROM\b| ?$|\))"
    heads = r"(?i)\bSELECT\b((?:(?!\bSELECT\b|\bFROM\b).)*)(?:\bFROM\b ?([\w.#]*))?"

    def check(seg: Column) -> Column:
        in_cte = seg.rlike(r"(?i)^AS ?\( ?SELECT")
        table = F.coalesce(F.nullif(F.regexp_extract(seg, r"(?i)\bFROM ([\w.]+)", 1), F.lit("")), F.lit("unknown"))
        severity = F.when(in_cte, "medium").otherwise("high")
        n = F.size(F.filter(F.regexp_extract_all(seg, F.lit(heads), F.lit(0)), lambda h: h.rlike(star)))
        one = finding(severity, says("All columns of ", lx.bare_name(table), " are read"),
                      says("Name the columns you need from ", lx.bare_name(table)), table=lx.bare_name(table))
        return F.when(n > 0, F.array_repeat(one, n)).otherwise(F.array().cast(f"array<{FINDING}>"))

    return F.flatten(F.transform(S.segs, check))


def missing_partition_filter() -> Column:
    """Needs ``partition_specs``: array<struct<table_name, columns: array<string>>>."""
    filtered = F.array_distinct(F.transform(
        F.flatten(F.transform(S.preds, lambda p: F.regexp_extract_all(
            F.regexp_replace(p, lx.LITERAL, " "), F.lit(r"([A-Za-z_][\w.]*)"), F.lit(1)))),
        lambda c: F.lower(lx.bare_name(c))))
    has_where = F.size(S.wheres) > 0

    def example(column: Column) -> Column:
        low = F.lower(column)
        return (
            F.when(F.contains(low, F.lit("year")), says(column, " = 2024"))
            .when(F.contains(low, F.lit("month")), says(column, " = 3"))
            .when(F.contains(low, F.lit("date")) | F.contains(low, F.lit("dt")), says(column, " >= '2024-01-01'"))
            .when(F.contains(low, F.lit("country")), says(column, " = 'US'"))
            .otherwise(says(column, " = <value>"))
        )

    def check(spec: Column) -> Column:
        missing = F.filter(spec["columns"], lambda c: ~F.array_contains(filtered, F.lower(c)))
        clause = listed(F.transform(F.slice(missing, 1, 2), example), " AND ")
        return F.when(F.size(missing) > 0, finding(
            "critical",
            says("Every partition of ", spec["table_name"], " is read: no filter on ", listed(missing)),
            says(F.when(has_where, "Add to the WHERE clause: ").otherwise("Add a WHERE clause: "), clause),
            table=spec["table_name"], missing_columns=listed(missing), has_where=has_where,
        ))

    return F.array_compact(F.transform(F.col("partition_specs"), check))


def cartesian_join() -> Column:
    def names(froms: Column) -> Column:
        return F.transform(lx.from_items(F.array(froms)), lambda t: lx.bare_name(F.regexp_extract(t, r"^([\w.]+)", 1)))

    def check(frm: Column) -> Column:
        tables = names(frm)
        crosses = F.regexp_count(frm, F.lit(r",(?![^⟨⟩]*⟩)")) + F.regexp_count(frm, F.lit(r"(?i)\bCROSS JOIN\b"))
        joins = F.regexp_count(frm, F.lit(r"(?i)\bJOIN\b")) - F.regexp_count(frm, F.lit(r"(?i)\b(?:CROSS|NATURAL(?: \w+)*) JOIN\b"))
        without = F.greatest(joins - F.regexp_count(frm, F.lit(r"(?i)\b(?:ON|USING)\b")), F.lit(0))
        open_joins = F.regexp_count(frm, F.lit(r"(?i)\bON TRUE\b(?! (?:AND|OR)\b| ?=)")) + without
        left, right = F.get(tables, F.lit(0)), F.element_at(tables, -1)
        key_fix = says("Join on a key: JOIN ", right, " ON ", left, ".key = ", right, ".key")
        comma = F.when(crosses >= 2, F.array(finding(
            "critical", says("Every row of ", listed(tables), " meets every other row"),
            F.lit("Write each table as a JOIN with its ON condition"), join_type=F.lit("implicit_comma"), tables=listed(tables))))
        cross = F.when(crosses == 1, F.array(finding(
            "critical", says("Every row of ", left, " meets every row of ", F.get(tables, F.lit(1))),
            key_fix, join_type=F.lit("cross_join"), tables=listed(tables))))
        loose = F.when(open_joins > 0, F.array_repeat(finding(
            "critical", says("The join of ", left, " and ", right, " has no condition"),
            key_fix, join_type=F.lit("join_without_on"), tables=listed(tables)), open_joins))
        none = F.array().cast(f"array<{FINDING}>")
        return F.concat(F.coalesce(comma, cross, none), F.coalesce(loose, none))

    return F.flatten(F.transform(S.froms, check))


def _level(name: Column) -> Column:
    low = F.lower(name)
    return F.when(_any_in(low, HIGH_NAMES), "high").when(_any_in(low, LOW_NAMES), "low").otherwise("unknown")


def group_by_cardinality() -> Column:
    groups = lx.slices(S.segs, r"(?i)\bGROUP BY\b(.*?)" + lx.CLAUSE_END.replace(r"\bGROUP BY\b|", ""))

    def check(group: Column) -> Column:
        names = F.filter(
            F.transform(F.filter(lx.comma_items(group), lambda i: ~i.rlike(r"^(\d+|'.*')$")),
                        lambda i: lx.bare_name(F.regexp_extract(i, lx.IDENTIFIER, 1))),
            lambda n: n != "")
        levels = F.transform(names, _level)
        high = F.array_position(levels, F.lit("high"))
        low = F.array_position(levels, F.lit("low"))
        of = lambda want: F.filter(names, lambda n: _level(n) == want)
        order = F.concat(of("low"), of("unknown"), of("high"))
        return F.when(
            (F.size(names) >= 2) & (high > 0) & (low > 0) & (high < low),
            finding("high", says("Grouping starts with many-valued ", listed(of("high")), " before ", listed(of("low"))),
                    says("Order the keys as GROUP BY ", listed(order)),
                    high_columns=listed(of("high")), low_columns=listed(of("low")), suggested_order=listed(order)))

    return F.array_compact(F.transform(groups, check))


def distinct_on_unique() -> Column:
    """Reads ``unique_columns``: registered unique columns of the referenced tables."""
    lists = lx.slices(S.segs, r"(?i)\bSELECT DISTINCT (.*?) FROM\b")

    def unique(name: Column) -> Column:
        low = F.lower(name)
        return low.rlike(f"(?:{'|'.join(UNIQUE_NAMES)})$") | F.exists(
            F.col("unique_columns"), lambda u: low.endswith(F.lower(u)))

    def check(items: Column) -> Column:
        plain = F.filter(lx.comma_items(items), lambda i: i.rlike(r"(?i)^[A-Za-z_][\w.]*( AS \w+| \w+)?$"))
        names = F.transform(plain, lambda i: lx.bare_name(F.regexp_extract(i, r"^([\w.]+)", 1)))
        hits = F.filter(names, unique)
        return F.when(F.size(hits) > 0, finding(
            "medium", says("DISTINCT over ", listed(hits), ", which is unique already"),
            says("Drop DISTINCT: ", listed(hits), " has no repeats"), unique_columns=listed(hits)))

    return F.array_compact(F.transform(lists, check))


def or_to_in() -> Column:
    clause = r"(?i)\b(?:SELECT|FROM|WHERE|ON|HAVING|GROUP BY|ORDER BY|LIMIT|WHEN|THEN|UNION|AS|IN)\b|[()]"
    chunks = F.flatten(F.transform(S.segs, lambda s: F.split(s, clause)))
    value = rf"({lx.LITERAL}|\d+(?:\.\d+)?)"

    def pairs(chunk: Column) -> Column:
        terms = F.transform(F.split(chunk, r"(?i)\bOR\b"), lambda x: F.trim(x))
        left = rf"^([A-Za-z_][\w.]*) ?= ?{value}$"
        right = rf"^{value} ?= ?([A-Za-z_][\w.]*)$"
        found = F.transform(terms, lambda t: F.struct(
            F.concat(F.regexp_extract(t, left, 1), F.regexp_extract(t, right, 2)).alias("col"),
            F.concat(F.regexp_extract(t, left, 2), F.regexp_extract(t, right, 1)).alias("val")))
        return F.when(F.size(terms) >= 3, F.filter(found, lambda x: x["col"] != ""))

    def check(found: Column) -> Column:
        columns = F.array_distinct(F.transform(found, lambda x: x["col"]))

        def one(column: Column) -> Column:
            mine = F.filter(found, lambda x: x["col"] == column)
            values = F.transform(mine, lambda x: F.coalesce(lx.literal_value(x["val"], S.parts), x["val"]))
            shown = listed(F.transform(F.slice(values, 1, 5), lambda v: says("'", v, "'")))
            more = F.when(F.size(values) > 5, ", ...").otherwise("")
            return F.when(F.size(mine) >= 3, finding(
                "medium", says(F.size(mine).cast("string"), " equality terms on ", column, " joined by OR"),
                says("Use ", column, " IN (", shown, more, ")"),
                column=column, conditions=F.size(mine), values=listed(values)))

        return F.array_compact(F.transform(columns, one))

    return F.flatten(F.transform(F.array_compact(F.transform(chunks, pairs)), check))


def like_no_wildcard() -> Column:
    hits = F.regexp_extract_all(S.code, F.lit(r"(?i)([\w.]*)(?: NOT)? LIKE '[12]:(\d+)'"), F.lit(0))

    def check(hit: Column) -> Column:
        column = lx.bare_name(F.regexp_extract(hit, r"^([\w.]*)", 1))
        value = lx.literal_value(hit, S.parts)
        return finding("low", says("LIKE '", value, "' has no wildcard"), says("Use ", column, " = '", value, "'"),
                       column=column, pattern=value)

    return F.transform(F.filter(hits, lambda h: h.rlike(r"(?i) LIKE '")), check)


def correlated_subquery() -> Column:
    subs = F.filter(lx.heads(F.array_distinct(S.segs)), lambda h: h["seg"].rlike(
        r"(?i)^(?!(?:EXISTS|AS) ?\()(?:\w+ ?)?\( ?SELECT\b"))

    def check(found: Column) -> Column:
        sub = found["seg"]
        body = F.regexp_replace(sub, lx.LITERAL, " ")
        froms = F.regexp_extract_all(F.regexp_replace(body, r"^[^(]*\(|\)$", " "), F.lit(r"(?i)\bFROM\b(.*?)" + lx.CLAUSE_END.replace("$)", r"\)|$)")), F.lit(1))
        items = lx.from_items(froms)
        words = F.flatten(F.transform(items, lambda t: F.array(
            lx.bare_name(F.regexp_extract(t, r"^([\w.]+)", 1)),
            F.regexp_extract(t, r"(?i)^[\w.]+ (?:AS )?(\w+)", 1))))
        defined = F.transform(words, F.lower)
        columns = F.array_distinct(F.regexp_extract_all(
            F.regexp_replace(body, r"(?i)\b(FROM|JOIN) [\w.]+", "$1 "), F.lit(r"([A-Za-z_]\w*\.[A-Za-z_]\w*)"), F.lit(1)))
        outer = F.array_sort(F.filter(columns, lambda c: ~F.array_contains(defined, F.lower(F.substring_index(c, ".", 1)))))
        before = F.get(lx.texts_before(S.marked, found["head"]), F.lit(0))
        last = F.upper(F.regexp_extract(before, r"(?i)^.*\b(SELECT|FROM|WHERE|HAVING|ON)\b", 1))
        aggregate = sub.rlike(rf"(?i)\b(?:{AGGREGATES}) ?[(⟨]|\bCOUNTDISTINCT:")
        kind = (
            F.when(last == "SELECT", "scalar_subquery_in_select")
            .when((last == "WHERE") & aggregate, "aggregate_subquery_in_where")
            .when(last == "WHERE", "subquery_in_where").otherwise("correlated_subquery")
        )
        return F.when(F.size(outer) > 0, finding(
            "high", says("Subquery depends on outer ", listed(outer)),
            F.when(kind == "scalar_subquery_in_select", "Aggregate the inner table by its key and LEFT JOIN it")
            .when(kind == "aggregate_subquery_in_where", "Join on a pre-aggregated inner table and filter on its result")
            .otherwise("Write it as a JOIN or as EXISTS on the key"),
            outer_columns=listed(outer), subquery_type=kind))

    return F.array_compact(F.transform(subs, check))


def _declared_class(declared: Column) -> Column:
    up, out = F.upper(declared), None
    for name, cls in TYPE_CLASSES:
        hit = F.contains(up, F.lit(name))
        out = F.when(hit, cls) if out is None else out.when(hit, cls)
    return out.otherwise("unknown")


def implicit_cast() -> Column:
    """Reads ``column_types``: array<struct<name, type>> of the referenced tables."""
    ops = r"(?:<=|>=|<>|!=|=|<|>)"
    value = rf"({lx.LITERAL}|\d+(?:\.\d+)?)"
    left = rf"^⟨* ?([A-Za-z_][\w.]*) ?{ops} ?{value} ?⟩*$"
    right = rf"^⟨* ?{value} ?{ops} ?([A-Za-z_][\w.]*) ?⟩*$"

    def check(pred: Column) -> Column:
        column = F.concat(F.regexp_extract(pred, left, 1), F.regexp_extract(pred, right, 2))
        masked = F.concat(F.regexp_extract(pred, left, 2), F.regexp_extract(pred, right, 1))
        low = F.lower(column)
        declared = F.filter(F.col("column_types"), lambda c: F.contains(F.lower(c["name"]), lx.bare_name(low)))
        guessed = (
            F.when(_any_in(low, STRING_NAMES), "string").when(_any_in(low, NUMBER_NAMES), "numeric")
            .when(_any_in(low, TIME_NAMES), "datetime")
        )
        col_class = F.when(F.size(declared) > 0, _declared_class(declared[0]["type"])).otherwise(guessed)
        lit_class = F.when(masked.startswith("'2"), "datetime").when(masked.startswith("'"), "string").otherwise("numeric")
        full = F.coalesce(lx.literal_value(masked, S.parts), masked)
        shown = F.when(F.length(full) > 50, F.concat(F.substring(full, 1, 47), F.lit("..."))).otherwise(full)
        fix = (
            F.when((col_class == "string") & (lit_class == "numeric"), says("Quote the literal: ", column, " = '", shown, "'"))
            .when((col_class == "numeric") & (lit_class == "string"),
                  says("Write a number: ", column, " = ", F.coalesce(F.nullif(F.regexp_replace(shown, r"[^0-9.]", ""), F.lit("")), shown)))
            .when((col_class == "datetime") & (lit_class == "string"), says("Use a date: ", column, " = CAST('", shown, "' AS DATE)"))
            .otherwise(says("Give the literal the type of ", column, " (", F.upper(col_class), ")"))
        )
        differs = (column != "") & (col_class != "unknown") & (col_class != lit_class)
        return F.when(differs, finding(
            "critical", says(column, " (", col_class, ") is compared with a ", lit_class, " literal"), fix,
            column=column, column_class=col_class, literal_class=lit_class, literal=shown))

    return F.array_compact(F.transform(S.preds, check))


def multi_count_distinct() -> Column:
    lists = lx.slices(S.segs, r"(?i)\bSELECT\b(.*?)(?=\bFROM\b|$)")

    def check(items: Column) -> Column:
        tokens = F.regexp_extract_all(items, F.lit(r"COUNTDISTINCT:(\w+ ?⟨[^⟩]*⟩|[\w.]+)"), F.lit(1))
        columns = F.transform(tokens, lambda t: F.when(F.contains(t, F.lit("⟨")), lx.restored(t, S.parts)).otherwise(lx.bare_name(t)))
        approx = listed(F.transform(F.slice(columns, 1, 3), lambda c: says("approx_count_distinct(", c, ")")))
        return F.when(F.size(columns) >= 2, finding(
            "high", says(F.size(columns).cast("string"), " exact distinct counts in one list: ", listed(columns)),
            says("If 2% error is fine use ", approx, ", or split the counts and join them"),
            count=F.size(columns), columns=listed(columns)))

    return F.array_compact(F.transform(lists, check))


def not_in_nulls() -> Column:
    tail = r"(?i)(?:([A-Za-z_][\w.]*) NOT|\bNOT ([A-Za-z_][\w.]*)) $"
    lists = F.filter(lx.heads(F.array_distinct(S.segs)), lambda h: h["seg"].rlike(r"(?i)^IN ?\("))

    def check(found: Column) -> Column:
        inner = F.trim(F.regexp_extract(found["seg"], r"(?is)^IN ?\((.*)\)$", 1))
        is_query = inner.rlike(r"(?i)^(SELECT|WITH)\b")
        chosen = F.regexp_extract(inner, r"(?i)^SELECT (?:DISTINCT )?(?:\w+ ?⟨ ?)*([A-Za-z_][\w.]*)", 1)
        guarded = F.contains(F.upper(inner), F.concat(F.upper(chosen), F.lit(" IS NOT NULL")))
        literals = inner.rlike(rf"{lx.LITERAL}|\d")

        def one(before: Column) -> Column:
            column = F.concat(F.regexp_extract(before, tail, 1), F.regexp_extract(before, tail, 2))
            return (
                F.when((column != "") & is_query & ~guarded, finding(
                    "high", says(column, " NOT IN (subquery): one null in ", chosen, " empties the result"),
                    says("Use NOT EXISTS, or add ", chosen, " IS NOT NULL to the subquery"),
                    column=column, kind=F.lit("subquery"), subquery_column=chosen))
                .when((column != "") & ~is_query & literals, finding(
                    "medium", says("Check nulls for ", column, " NOT IN (list)"),
                    says("Write (", column, " NOT IN (...) OR ", column, " IS NULL) to keep null rows"),
                    column=column, kind=F.lit("list"), values=F.size(lx.comma_items(inner))))
            )

        return F.array_compact(F.transform(lx.texts_before(S.marked, found["head"]), one))

    return F.flatten(F.transform(lists, check))


def window_no_partition() -> Column:
    windows = F.filter(lx.heads(F.array_distinct(S.segs)), lambda h: h["seg"].rlike(rf"(?i)^OVER ?\((?: ?\)|{lx.WINDOW_PARTS})")
                       & ~h["seg"].rlike(r"(?i)\b(?:PARTITION|DISTRIBUTE) BY\b"))

    def one(before: Column) -> Column:
        # The call in front, its arguments closed from the inside out.
        call = lx.settled(F.regexp_replace(before, r"(?i)\bCOUNTDISTINCT:[\w.]+(?:⟨[^⟨⟩]*+⟩)?+", "COUNT§"),
                          lx.how_many(before, "⟨"), lambda x: F.regexp_replace(x, "⟨[^⟨⟩]*+⟩", "§"))
        function = F.upper(F.regexp_extract(call, r"(\w+) ?[§#] ?$", 1))
        return F.when(function != "", finding(
            "high", says(function, " runs over one single partition"),
            F.lit("Add PARTITION BY with a key of many values"), function=function))

    def by_name(scope: Column) -> Column:
        loose = F.filter(lx.window_uses(scope), lambda u: u["known"] & ~u["divided"])
        return F.array_compact(F.transform(loose, lambda u: one(u["before"])))

    here = F.flatten(F.transform(windows, lambda h: F.array_compact(F.transform(lx.texts_before(S.marked, h["head"]), one))))
    named = F.filter(S.scopes, lambda s: s.rlike(r"(?i)\bWINDOW\b"))
    return F.concat(here, F.flatten(F.transform(named, by_name)))


def union_no_all() -> Column:
    def check(seg: Column) -> Column:
        ops = F.transform(F.regexp_extract_all(seg, F.lit(r"(?i)\bUNION(?: ALL)?\b"), F.lit(0)), F.upper)

        def one(op: Column, i: Column) -> Column:
            branches = i + 2
            return F.when(op == "UNION", finding(
                F.when(branches > 3, "high").otherwise("medium"),
                says("UNION removes repeats over ", branches.cast("string"), " branches"),
                F.lit("Use UNION ALL where repeats cannot occur or do not matter"), branches=branches))

        return F.array_compact(F.transform(ops, one))

    return F.flatten(F.transform(S.segs, check))


def inefficient_merge() -> Column:
    whens = F.regexp_extract_all(S.code, F.lit(r"(?i)\bWHEN MATCHED\b(.*?)(?=\bWHEN (?:NOT )?MATCHED\b|$)"), F.lit(1))
    target = lx.bare_name(F.regexp_extract(S.code, r"(?i)^MERGE INTO ([\w.]+)", 1))
    updates = F.filter(whens, lambda w: w.rlike(r"(?i)\bTHEN UPDATE\b"))

    def reason(when: Column) -> Column:
        condition = F.trim(F.regexp_extract(when, r"(?i)^ ?AND (.*?) ?THEN UPDATE\b", 1))
        sides = F.regexp_extract_all(condition, F.lit(r"(\w+\.\w+ ?(?:<>|!=) ?\w+\.\w+)"), F.lit(1))
        crossed = F.exists(sides, lambda s: F.regexp_extract(s, r"^(\w+)\.", 1) != F.regexp_extract(s, r"(?:<>|!=) ?(\w+)\.", 1))
        hashed = condition.rlike(r"(?i)\b(HASH|MD5|SHA1|SHA2) ?\(")
        return F.when(condition == "", "no_condition").when(~crossed & ~hashed, "no_change_check")

    bad = F.array_compact(F.transform(updates, reason))
    found = F.array(finding(
        "high", says("MERGE INTO ", target, " rewrites rows that did not change"),
        F.when(bad[0] == "no_condition", "Add a condition: WHEN MATCHED AND t.col <> s.col THEN UPDATE")
        .otherwise("Extend the condition by a comparison of old and new values or of row hashes"),
        target=target, reason=bad[0], updates=F.size(bad)))
    return F.when(S.code.rlike(r"(?i)^MERGE INTO\b") & (F.size(bad) > 0), found).otherwise(F.array().cast(f"array<{FINDING}>"))


class Rule(NamedTuple):
    rule_id: str
    severity: str
    check: Callable[[], Column]


# rule_key is the identity; three of the older numeric ids are used twice.
RULES: dict[str, Rule] = {
    "NON_SARGABLE": Rule("SPARK_001", "high", non_sargable),
    "SELECT_STAR": Rule("SPARK_002", "high", select_star),
    "MISSING_PARTITION_FILTER": Rule("SPARK_003", "critical", missing_partition_filter),
    "CARTESIAN_JOIN": Rule("SPARK_004", "critical", cartesian_join),
    "GROUP_BY_CARDINALITY": Rule("SPARK_005", "high", group_by_cardinality),
    "DISTINCT_ON_UNIQUE": Rule("SPARK_006", "medium", distinct_on_unique),
    "OR_TO_IN": Rule("SPARK_007", "medium", or_to_in),
    "LIKE_NO_WILDCARD": Rule("SPARK_008", "low", like_no_wildcard),
    "CORRELATED_SUBQUERY": Rule("SPARK_008", "high", correlated_subquery),
    "IMPLICIT_CAST": Rule("SPARK_009", "critical", implicit_cast),
    "MULTI_COUNT_DISTINCT": Rule("SPARK_009", "high", multi_count_distinct),
    "NOT_IN_NULLS": Rule("SPARK_010", "high", not_in_nulls),
    "WINDOW_NO_PARTITION": Rule("SPARK_010", "high", window_no_partition),
    "UNION_NO_ALL": Rule("SPARK_011", "medium", union_no_all),
    "INEFFICIENT_MERGE": Rule("SPARK_012", "high", inefficient_merge),
}
DEFAULT_RULES = ("CARTESIAN_JOIN", "NON_SARGABLE", "SELECT_STAR")


_BUILT: dict[tuple[str, str], Column] = {}


def findings_of(key: str, app: str) -> Column:
    """The rule's Column, built once per application; it only refers to columns by name."""
    if (app, key) not in _BUILT:
        _BUILT[app, key] = F.coalesce(RULES[key].check(), F.array().cast(f"array<{FINDING}>"))
    return _BUILT[app, key]


def register_rule(key: str, rule_id: str, severity: str, check: Callable[[], Column]) -> None:
    """Add a user rule: a function that returns an array of ``finding`` columns."""
    if key in RULES:
        raise ValueError(f"rule {key} exists")
    RULES[key] = Rule(rule_id, severity, check)


def unregister_rule(key: str) -> None:
    RULES.pop(key)
    for built in [k for k in _BUILT if k[1] == key]:
        del _BUILT[built]


def distinct_texts(statements: DataFrame) -> DataFrame:
    """Each text without its comments once, with its hash. Grouping has a map-side combine, so
    copies of a hot text never meet in one task.

    The texts are few bytes but much regex work, so they keep the full shuffle width instead
    of being packed into few tasks by size.
    """
    width = int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        statements.select(lx.without_comments(F.col("statement_text")).alias("statement_text"))
        .filter(F.col("statement_text") != "").distinct()
        .withColumn("query_hash", statement_hash(F.col("statement_text")))
        .repartition(width, "query_hash")
    )


CONTEXT_KINDS = {
    "partition_specs": "array<struct<table_name:string,columns:array<string>>>",
    "unique_columns": "array<string>",
    "column_types": "array<struct<name:string,type:string>>",
}


def with_context(texts: DataFrame, partitions: DataFrame | None = None, uniques: DataFrame | None = None,
                 columns: DataFrame | None = None) -> DataFrame:
    """Attach measured table facts to each text by the tables it names.

    ``partitions`` and ``uniques`` have (table_name, column_name), ``columns`` has
    (table_name, column_name, data_type).
    """
    base = prepared(texts)
    if partitions is None and uniques is None and columns is None:
        return base.withColumns({name: F.array().cast(kind) for name, kind in CONTEXT_KINDS.items()})
    # One row of facts per table; a table is as wide as its definition.
    facts = None
    for df, name, item in (
        (partitions, "partition_columns", F.col("column_name")), (uniques, "unique_names", F.col("column_name")),
        (columns, "types", F.struct(F.col("column_name").alias("name"), F.col("data_type").alias("type"))
         if columns is not None else None),
    ):
        if df is None:
            continue
        one = df.groupBy("table_name").agg(F.array_sort(F.collect_set(item)).alias(name))
        facts = one if facts is None else facts.join(one, "table_name", "full_outer")
    for name, kind in (("partition_columns", "array<string>"), ("unique_names", "array<string>"),
                       ("types", "array<struct<name:string,type:string>>")):
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    # The lexical columns ride along once per named table, so the regex work is done once.
    rest = [c for c in base.columns if c not in texts.columns]
    wide = base.select(
        *texts.columns, F.struct(*rest).alias("lex"), F.explode_outer("tables").alias("table_name"))
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = wide.join(facts, "table_name", "left").groupBy(*texts.columns).agg(
        F.any_value("lex").alias("lex"),
        F.array_sort(F.collect_list(F.when(F.size("partition_columns") > 0, F.struct(
            "table_name", F.col("partition_columns").alias("columns"))))).alias("partition_specs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("unique_names")))).alias("unique_columns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("column_types"),
    ).repartition(width, F.xxhash64("statement_text"))
    return joined.select(*texts.columns, "lex.*", *CONTEXT_KINDS)


def detect(texts: DataFrame, keys: list[str] | tuple[str, ...] | None = None, more: Column | None = None) -> DataFrame:
    """Findings of the chosen rules per text, long form with an ordinal.

    ``texts`` comes from ``with_context``; ``more`` is an array of further findings with the rule's names.
    """
    chosen = list(keys or RULES)
    app = texts.sparkSession.sparkContext.applicationId

    def tagged(key: str) -> Column:
        rule = RULES[key]
        return F.transform(findings_of(key, app), lambda v: F.struct(
            F.lit(key).alias("rule_key"), F.lit(rule.rule_id).alias("rule_id"), v["severity"].alias("severity"),
            v["message"].alias("message"), v["context"].alias("context"), v["fix"].alias("fix")))

    rest = [c for c in ("query_hash", "statement_text") if c in texts.columns]
    columns = {k: tagged(k) for k in chosen} | ({} if more is None else {"_more": more})
    per_rule = texts.select(*rest, *[c.alias(k) for k, c in columns.items()])
    # An outer explode: for an inner one Spark derives a filter on the array, which would run
    # the rules a second time, below the distinct, on every execution of a text.
    return (
        per_rule.select(*rest, F.posexplode_outer(F.concat(*[F.col(k) for k in columns])).alias("pos", "v"))
        .filter(F.col("v").isNotNull())
        .select(*rest, (F.col("pos") + 1).alias("ordinal"), "v.*")
    )


def detect_statements(statements: DataFrame, keys=None, **context: DataFrame) -> DataFrame:
    """Distinct texts are analysed once; findings fan out to every statement with that text."""
    found = detect(with_context(distinct_texts(statements), **context), keys)
    # The history meets the findings by digest, so its texts are not shuffled.
    runs = statements.select("statement_id", "executed_by", lx.text_key(F.col("statement_text")).alias("_digest"))
    own = found.withColumn("_digest", F.sha2("statement_text", 256)).drop("statement_text", "query_hash")
    return runs.join(own, "_digest").drop("_digest")


#: A rule table of up to this many rows goes to every task.
CONFIG_ROWS = 10_000


def with_rule_config(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply the configured severity and message; findings of disabled rules drop out.

    Rule keys are few and some are hot, so findings are not shuffled by them: the rules are counted, and
    up to CONFIG_ROWS of them are broadcast. Beyond that the join is Spark's choice.
    """
    config = rules.select(
        F.col("rule_key"), F.col("severity").alias("set_severity"), F.col("enabled"),
        F.col("custom_message"), F.col("confidence"),
    )
    if config.limit(CONFIG_ROWS + 1).count() <= CONFIG_ROWS:
        config = F.broadcast(config)
    return (
        violations.join(config, "rule_key", "left").filter(F.coalesce("enabled", F.lit(True)))
        .withColumn("severity", F.coalesce("set_severity", "severity"))
        .withColumn("message", F.coalesce("custom_message", "message"))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.8)))
        .drop("set_severity", "custom_message", "enabled")
    )


def with_statements(statements: DataFrame, violations: DataFrame) -> DataFrame:
    """Every statement with its findings; blank or clean statements have none."""
    per = violations.groupBy("statement_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "rule_key", "rule_id", "severity", "message", "context", "fix")),
                     lambda a, b: F.when(a["ordinal"] < b["ordinal"], -1).when(a["ordinal"] > b["ordinal"], 1).otherwise(0)
                     ).alias("violations"))
    return statements.join(per, "statement_id", "left").withColumn(
        "violation_count", F.coalesce(F.size("violations"), F.lit(0)))
