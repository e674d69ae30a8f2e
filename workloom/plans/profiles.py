"""Profiles that back the advice with numbers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from workloom.operators import profile_store
from workloom.operators import profiles as p
from workloom.plans.registry import query
from workloom.session import shared_folder
from workloom.sources.tables import table

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value"]


@query("M1_join_fan_out", """
SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM customer) AS right_rows, sum(j) AS join_rows, max(j) AS largest_key_rows,
 (SELECT count(*) FROM orders) * (SELECT count(*) FROM customer) AS cross_rows,
 (SELECT count(*) FROM orders)::DOUBLE * (SELECT count(*) FROM customer) / sum(j)::DOUBLE AS blow_up
FROM (SELECT count(*) AS j FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey)""")
def m1(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return p.join_fan_out(o, c, "k")


@query("M1_fan_out_by_key", """
SELECT l.l_partkey AS k, l.n AS n_left, e.n AS n_right, l.n * e.n AS join_rows FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) l
JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON l.l_partkey = e.user_id""")
def m1k(spark, d):
    left = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    right = table(spark, d, "events").select(F.col("user_id").alias("k"))
    return p.fan_out_by_key(left, right, "k")


@query("M2_cardinality", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count(*) AS rows,
 CASE WHEN count(DISTINCT {c}) / count(*)::DOUBLE > 0.1 THEN 'high' ELSE 'low' END AS cardinality FROM events""" for c in EVENT_COLUMNS))
def m2(spark, d):
    return p.cardinality(table(spark, d, "events"), EVENT_COLUMNS)


@query("M2_cardinality_approx")
def m2a(spark, d):
    return p.cardinality_approx(table(spark, d, "events"), EVENT_COLUMNS)


@query("M3_uniqueness", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS rows, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS nulls,
 count(DISTINCT {c}) = count(*) AND count({c}) = count(*) AS is_unique FROM orders""" for c in ("o_orderkey", "o_custkey", "o_orderdate")))
def m3(spark, d):
    return p.uniqueness(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])


NULLED = "SELECT nullif(l_returnflag, 'R') AS flag, nullif(l_linenumber, 1) AS line, l_orderkey FROM {lineitem}"


@query("M4_null_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS rows, count(*) > count({c}) AS not_in_risk FROM ({NULLED.format(lineitem='lineitem')})"
    for c in ("flag", "line", "l_orderkey")))
def m4(spark, d):
    return p.null_counts(spark.sql(NULLED, lineitem=table(spark, d, "lineitem")), ["flag", "line", "l_orderkey"])


CODES = """SELECT CASE o_orderkey % 5 WHEN 0 THEN concat('0', CAST(o_orderkey AS VARCHAR(20))) WHEN 1 THEN o_orderpriority WHEN 2 THEN NULL
 ELSE CAST(o_custkey AS VARCHAR(20)) END AS code FROM {orders}"""


@query("M5_cast_safety", f"""SELECT count(*) AS rows, count(code) AS present, count(*) FILTER (code IS NOT NULL AND try_cast(code AS BIGINT) IS NULL) AS failed,
 count(*) FILTER (CAST(try_cast(code AS BIGINT) AS VARCHAR) <> code) AS changed FROM ({CODES.format(orders='orders')})""")
def m5(spark, d):
    return p.cast_safety(spark.sql(CODES, orders=table(spark, d, "orders")), "code", "bigint")


@query("M6_union_duplicates", """SELECT CAST(sum(n) AS BIGINT) AS all_rows, count(*) AS distinct_rows, CAST(sum(n - b) AS BIGINT) AS repeats_within, CAST(sum(b - 1) AS BIGINT) AS repeats_across
FROM (SELECT k, count(*) AS n, count(DISTINCT br) AS b FROM (SELECT o_custkey AS k, 0 AS br FROM orders UNION ALL SELECT c_custkey, 1 FROM customer) GROUP BY k)""")
def m6(spark, d):
    return p.union_duplicates(
        table(spark, d, "orders").select(F.col("o_custkey").alias("k")),
        table(spark, d, "customer").select(F.col("c_custkey").alias("k")),
    )


@query("M7_partition_shares", """SELECT strftime(l_shipdate, '%Y-%m') AS partition_value, count(*) AS rows, strftime(l_shipdate, '%Y-%m') >= '1997-01' AS is_read
FROM lineitem GROUP BY ALL""")
def m7(spark, d):
    return p.partition_shares(
        table(spark, d, "lineitem"), F.date_format("l_shipdate", "yyyy-MM"), F.col("partition_value") >= "1997-01"
    )


@query("M7_scanned_share", """SELECT count(*) AS partitions, count(*) FILTER (m >= '1997-01') AS partitions_read, CAST(sum(n) AS BIGINT) AS rows,
 CAST(sum(CASE WHEN m >= '1997-01' THEN n ELSE 0 END) AS BIGINT) AS rows_read
FROM (SELECT strftime(l_shipdate, '%Y-%m') AS m, count(*) AS n FROM lineitem GROUP BY 1)""")
def m7s(spark, d):
    return p.scanned_share(m7(spark, d))


@query("M8_approximation_error")
def m8(spark, d):
    return p.approximation_error(table(spark, d, "events"), EVENT_COLUMNS)


#: Estimates lie within three standard errors of the exact count, up to a chance of about 0.003.
HOLDS = 3


@query("M8_approximation_holds", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS exact, true AS holds FROM events" for c in EVENT_COLUMNS))
def m8_holds(spark, d):
    error = p.approximation_error(table(spark, d, "events"), EVENT_COLUMNS, 0.02)
    return error.select("column_name", "exact", (F.col("relative_error") <= HOLDS * 0.02).alias("holds"))


@query("M2_cardinality_approx_holds", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, true AS holds FROM events" for c in EVENT_COLUMNS))
def m2_holds(spark, d):
    events = table(spark, d, "events")
    exact = p.cardinality(events, EVENT_COLUMNS).select("column_name", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_values") - F.col("exact"))
    return p.cardinality_approx(events, EVENT_COLUMNS).join(exact, "column_name").select(
        "column_name", "rows", (off <= HOLDS * 0.02 * F.col("exact")).alias("holds"))


# --- profiles as stored states ----------------------------------------------------------------------

_EVENT_STORES: dict[tuple[str, str], str] = {}


def event_profiles(spark, d, version):
    """The profile of the events as of a version: even thousands of ids are written first, odd ones later."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _EVENT_STORES:
        path = f"{shared_folder(spark).rstrip('/')}/profiles-{uuid.uuid4().hex}"
        for number, ids in ((1, "event_id div 1000 % 2 = 0"), (2, "event_id div 1000 % 2 = 1")):
            part = table(spark, d, "events").filter(ids)
            profile_store.append(profile_store.states(
                part, "main.web.events", EVENT_COLUMNS, "event_id", keys=("event_id", "user_id"), value=F.expr("event_id div 1000")), path, number)
        _EVENT_STORES[key] = path
    return profile_store.merged(profile_store.read(spark, _EVENT_STORES[key], version))


@query("M2_profile_store", " UNION ALL ".join(
    f"""SELECT {v} AS version, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, true AS estimate_holds,
 {"count(DISTINCT event_id) = count(*)" if c == "event_id" else "false"} AS is_unique FROM events WHERE {ids}"""
    for v, ids in ((1, "event_id // 1000 % 2 = 0"), (2, "event_id IS NOT NULL")) for c in EVENT_COLUMNS))
def m2_store(spark, d):
    """Merged states of both versions; the estimate is held against an exact count, within three standard errors."""
    out = None
    for version, ids in ((1, "event_id div 1000 % 2 = 0"), (2, "event_id IS NOT NULL")):
        exact = p.cardinality(table(spark, d, "events").filter(ids), EVENT_COLUMNS).select("column_name", "distinct_values")
        off = F.abs(F.col("distinct_estimate") - F.col("distinct_values"))
        one = event_profiles(spark, d, version).join(exact, "column_name").select(
            F.lit(version).alias("version"), "column_name", "rows", "nulls",
            (off <= 3 * profile_store.STANDARD_ERROR * F.col("distinct_values") + 1).alias("estimate_holds"), "is_unique")
        out = one if out is None else out.unionByName(one)
    return out
