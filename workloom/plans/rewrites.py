"""Rewrites next to the naive SQL that they replace."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from workloom.operators import merge_store
from workloom.operators import rewrites as r
from workloom.plans.detection import profiled
from workloom.plans.profiles import event_profiles
from workloom.plans.registry import query
from workloom.session import shared_folder
from workloom.sources.tables import table


@query("R1_date_range", """
SELECT 'year' AS unit, o_orderkey FROM orders WHERE year(o_orderdate) = 1997
UNION ALL SELECT 'quarter', o_orderkey FROM orders WHERE year(o_orderdate) = 1996 AND quarter(o_orderdate) = 4
UNION ALL SELECT 'month', o_orderkey FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1995-12-01'
UNION ALL SELECT 'day', o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-15'""")
def r1(spark, d):
    orders, when = table(spark, d, "orders"), F.col("o_orderdate")
    spans = {"year": dt.date(1997, 1, 1), "quarter": dt.date(1996, 10, 1), "month": dt.date(1995, 12, 1), "day": dt.date(1995, 3, 15)}
    return r.union_all(*[
        orders.filter(r.date_range(when, unit, start)).select(F.lit(unit).alias("unit"), "o_orderkey")
        for unit, start in spans.items()
    ])


@query("R2_isolated_column", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * 2 > 100000 AND l_quantity + 10 < 40 AND l_quantity - 5 >= 2
 AND l_extendedprice / 4 <= 15000 AND l_quantity * -1 > -25 AND l_orderkey % 3 = 1""")
def r2(spark, d):
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, d, "lineitem").filter(
        r.isolate(price, "*", 2, ">", 100000) & r.isolate(qty, "+", 10, "<", 40) & r.isolate(qty, "-", 5, ">=", 2)
        & r.isolate(price, "/", 4, "<=", 15000) & r.isolate(qty, "*", -1, ">", -25)
        & r.isolate(F.col("l_orderkey"), "%", 3, "=", 1)
    ).select("l_orderkey", "l_linenumber")


@query("R3_function_predicates", """
SELECT c_custkey FROM customer WHERE substr(c_name, 1, 14) = 'Customer#00000' AND abs(c_acctbal) > 500 AND trunc(c_acctbal / 1000) <> 3
 AND (trunc(c_acctbal / 1000) = 5 OR trunc(c_acctbal / 1000) = 0 OR c_custkey > 10)""")
def r3(spark, d):
    bal = F.col("c_acctbal")
    kilo = bal / 1000
    return table(spark, d, "customer").filter(
        r.prefix_is(F.col("c_name"), "Customer#00000") & r.outside(bal, 500) & ~r.whole_part_is(kilo, 3)
        & (r.whole_part_is(kilo, 5) | r.whole_part_is(kilo, 0) | (F.col("c_custkey") > 10))
    ).select("c_custkey")


@query("R4_projection", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def r4(spark, d):
    return r.project(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"])


LINEITEM_KEPT = ["l_orderkey", "l_linenumber", "l_quantity"]


@query("R4_projection_report", f"""SELECT column_name, column_name IN ({', '.join(f"'{c}'" for c in LINEITEM_KEPT)}) AS kept, n_values
 FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM lineitem) ON COLUMNS(*) INTO NAME column_name VALUE n_values)""")
def r4_report(spark, d):
    return r.projection_report(table(spark, d, "lineitem"), LINEITEM_KEPT)


@query("R5_pruned_read", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
 WHERE year(l_shipdate) = 1996 AND month(l_shipdate) = 3""")
def r5(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    path = r.write_partitioned(spark, lines, {"ship_year": F.year("l_shipdate"), "ship_month": F.month("l_shipdate")})
    return r.read_pruned(spark, path, {"ship_year": 1996, "ship_month": 3}, ["l_orderkey", "l_linenumber", "l_quantity"])


@query("R6_or_to_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' OR o_orderpriority = '5-LOW'")
def r6(spark, d):
    return table(spark, d, "orders").filter(
        r.any_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "5-LOW"])
    ).select("o_orderkey")


@query("R7_like_to_equal", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-URGENT'")
def r7(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")


@query("R8_typed_literal", """SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'""")
def r8(spark, d):
    c = table(spark, d, "customer")
    return r.typed_equal(r.typed_equal(c, "c_nationkey", "7"), "c_mktsegment", "BUILDING").select("c_custkey")


@query("R9_keyed_join", "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_totalprice > 100000")
def r9(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 100000")
    return r.keyed_join(o, table(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("R10_ordered_group_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def r10(spark, d):
    """The order of the keys comes from stored profiles: one row per column."""
    events = table(spark, d, "events")
    known = {x["column_name"]: x["distinct_estimate"] for x in event_profiles(spark, d, 2).collect()}
    keys = r.ordered_keys(known, ["user_id", "event_type"])
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


@query("R11_distinct_dropped", "SELECT DISTINCT o_orderkey FROM orders")
def r11(spark, d):
    """The guard is the stored proof that the key is unique."""
    known = profiled(spark, d).filter("table_name = 'main.sales.orders' AND column_name = 'o_orderkey'").first()
    return r.distinct_unless_unique(table(spark, d, "orders"), "o_orderkey", known is not None and known["is_unique"])


@query("R12_decorrelated", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top_price FROM customer""")
def r12(spark, d):
    orders = table(spark, d, "orders")
    return r.with_aggregate(
        table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey",
        {"n_orders": F.count("*"), "top_price": F.max("o_totalprice")}, zero=("n_orders",),
    )


COUNTS = "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_o_custkey, count(DISTINCT o_orderdate) AS n_o_orderdate FROM orders GROUP BY 1"


@query("R13_distinct_exact", COUNTS)
def r13(spark, d):
    return r.distinct_counts(table(spark, d, "orders"), ["o_orderpriority"], ["o_custkey", "o_orderdate"])


@query("R13_distinct_split", COUNTS)
def r13s(spark, d):
    return r.distinct_counts_split(table(spark, d, "orders"), ["o_orderpriority"], ["o_custkey", "o_orderdate"])


@query("R13_distinct_approx")
def r13a(spark, d):
    return r.distinct_counts_approx(table(spark, d, "orders"), ["o_orderpriority"], ["o_custkey", "o_orderdate"])


@query("R13_distinct_approx_holds", "SELECT DISTINCT o_orderpriority, true AS n_o_custkey, true AS n_o_orderdate FROM orders")
def r13_holds(spark, d):
    """Whether each estimate lies within three standard errors of the exact count."""
    orders, keys, columns = table(spark, d, "orders"), ["o_orderpriority"], ["o_custkey", "o_orderdate"]
    near = r.distinct_counts_approx(orders, keys, columns, 0.02).select(*keys, *[F.col(f"n_{c}").alias(f"near_{c}") for c in columns])
    return r.distinct_counts(orders, keys, columns).join(near, keys).select(*keys, *[
        (F.abs(F.col(f"near_{c}") - F.col(f"n_{c}")) <= 3 * 0.02 * F.col(f"n_{c}")).alias(f"n_{c}") for c in columns])


LEFT = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k FROM customer)"
RIGHT = "(SELECT CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE o_custkey * 2 END AS k FROM orders)"


def sides(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"))
    right = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 100 != 0, F.col("o_custkey") * 2).alias("r"))
    return left, right


@query("R14_not_in_null_aware", f"""
SELECT 'raw' AS form, id FROM {LEFT} l WHERE k NOT IN (SELECT k FROM {RIGHT})
UNION ALL SELECT 'clean', id FROM {LEFT} l WHERE k NOT IN (SELECT o_custkey * 2 FROM orders)""")
def r14(spark, d):
    left, right = sides(spark, d)
    clean = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("r"))
    return r.union_all(
        r.not_in_null_aware(left, right, "k", "r").select(F.lit("raw").alias("form"), "id"),
        r.not_in_null_aware(left, clean, "k", "r").select(F.lit("clean").alias("form"), "id"),
    )


@query("R14_not_exists", f"SELECT id FROM {LEFT} l WHERE NOT EXISTS (SELECT 1 FROM {RIGHT} r WHERE r.k = l.k)")
def r14e(spark, d):
    return r.not_exists(*sides(spark, d), "k", "r").select("id")


@query("R14_not_in_filtered", f"SELECT id FROM {LEFT} l WHERE k NOT IN (SELECT k FROM {RIGHT} r WHERE k IS NOT NULL)")
def r14f(spark, d):
    return r.not_in_filtered(*sides(spark, d), "k", "r").select("id")


@query("R14_not_in_list", f"SELECT id FROM {LEFT} l WHERE k NOT IN (1, 2, 3) OR k IS NULL")
def r14l(spark, d):
    return r.not_in_list(sides(spark, d)[0], "k", [1, 2, 3]).select("id")


@query("R15_partitioned_rank", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders""")
def r15(spark, d):
    """Three status values: each is ranked in month buckets, not in one task."""
    return r.ranked(
        table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"],
        F.date_trunc("month", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")],
    ).select("o_orderkey", "rn")


@query("R16_union_all", "SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def r16(spark, d):
    return r.union_all(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("R16_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def r16d(spark, d):
    return r.union_distinct(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


CHANGES = """SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 10000000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
 CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
 CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM {orders} WHERE o_orderkey % 4 <> 3"""
MERGED_SQL = f"""SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
 CASE WHEN action IN ('insert', 'update') THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
 CASE WHEN action IN ('insert', 'update') THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus, action
FROM (SELECT t, s, CASE WHEN t.o_orderkey IS NULL THEN 'insert' WHEN s.o_orderkey IS NULL THEN 'keep'
 WHEN t.o_totalprice IS DISTINCT FROM s.o_totalprice OR t.o_orderstatus IS DISTINCT FROM s.o_orderstatus THEN 'update' ELSE 'unchanged' END AS action
 FROM orders t FULL OUTER JOIN ({CHANGES.format(orders='orders')}) s ON t.o_orderkey = s.o_orderkey)"""


def merged(spark, d, by_hash=False):
    orders = table(spark, d, "orders")
    target = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    source = spark.sql(CHANGES, orders=orders)
    return r.merge(target, source, ["o_orderkey"], ["o_totalprice", "o_orderstatus"], by_hash)


@query("R17_change_merge", MERGED_SQL)
def r17(spark, d):
    return merged(spark, d).select("o_orderkey", "o_totalprice", "o_orderstatus", "action")


@query("R17_change_merge_hash", MERGED_SQL)
def r17h(spark, d):
    return merged(spark, d, by_hash=True).select("o_orderkey", "o_totalprice", "o_orderstatus", "action")


@query("R17_written_merge", f"""SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN action IN ('insert', 'update') THEN action ELSE 'same' END AS action,
 2 AS version, 0 AS written_again FROM ({MERGED_SQL})""")
def r17w(spark, d):
    """The orders as a merged table: the changes are merged twice, and the second time writes nothing."""
    path = f"{shared_folder(spark).rstrip('/')}/merged-orders-{uuid.uuid4().hex}"
    orders, keys = table(spark, d, "orders"), ["o_orderkey"]
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    merge_store.create(orders.select(*columns), path, keys)
    changes = spark.sql(CHANGES, orders=orders).select(*columns)
    merge_store.merge_into(changes, path, keys, ["o_totalprice", "o_orderstatus"])
    again = merge_store.merge_into(changes, path, keys, ["o_totalprice", "o_orderstatus"])
    moved = merge_store.log(spark, path).select(*keys, "action")
    return merge_store.read(spark, path).join(moved, keys, "left").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.coalesce("action", F.lit("same")).alias("action"),
        F.lit(again["version"]).alias("version"), F.lit(again["buckets_written"]).alias("written_again"))


@query("R17_former_versions", """SELECT t.o_orderkey, t.o_totalprice AS before_price, s.o_totalprice AS after_price, t.o_orderstatus AS before_status, s.o_orderstatus AS after_status
 FROM orders t JOIN (""" + CHANGES.format(orders="orders") + """) s ON t.o_orderkey = s.o_orderkey WHERE t.o_totalprice IS DISTINCT FROM s.o_totalprice OR t.o_orderstatus IS DISTINCT FROM s.o_orderstatus""")
def r17v(spark, d):
    """What a merge changed, from the two versions of the table, without its log."""
    path = f"{shared_folder(spark).rstrip('/')}/merged-orders-{uuid.uuid4().hex}"
    orders, keys = table(spark, d, "orders"), ["o_orderkey"]
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    merge_store.create(orders.select(*columns), path, keys)
    merge_store.merge_into(spark.sql(CHANGES, orders=orders).select(*columns), path, keys)
    side = lambda at, name: merge_store.read(spark, path, at).select(
        "o_orderkey", F.col("o_totalprice").alias(f"{name}_price"), F.col("o_orderstatus").alias(f"{name}_status"))
    same = F.col("before_price").eqNullSafe(F.col("after_price")) & F.col("before_status").eqNullSafe(F.col("after_status"))
    return side(1, "before").join(side(2, "after"), keys).filter(~same)


@query("R18_rewrites_avoided", f"""SELECT count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated,
 count(*) FILTER (action IN ('update', 'unchanged')) AS unconditional_updates, count(*) FILTER (action = 'unchanged') AS rewrites_avoided,
 count(*) FILTER (action = 'keep') AS untouched FROM ({MERGED_SQL})""")
def r18(spark, d):
    return r.merge_summary(merged(spark, d))
