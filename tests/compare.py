"""Run registered queries next to their comparison SQL and compare the rows as multisets."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from workloom.sources.tables import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    if type(v).__name__ == "Decimal":
        return _cell(float(v))
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        in_g, in_w = set(got), set(want)
        only_g = [r for r in got if r not in in_w][:2]
        only_w = [r for r in want if r not in in_g][:2]
        return f"rows differ: {len(got)} vs {len(want)}\n   spark {only_g}\n   sql   {only_w}"
    return None if got else "both empty"


def main():
    from __spark_entry__ import oracle_sql, queries
    from workloom.session import local_session

    folder = "/root/testdata/sf0.01"
    picks = sys.argv[1:]
    if picks and picks[0].startswith("/"):
        folder, picks = picks[0], picks[1:]
    spark = local_session()
    con = connect(folder)
    todo, oracles, bad = queries(), oracle_sql(), 0
    for name, fn in todo.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        start = time.time()
        try:
            if name in oracles:
                note = compare(spark, con, folder, name, fn, oracles[name])
            else:
                n = fn(spark, folder).count()
                note = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            note = f"{type(e).__name__}: {str(e)[:700]}"
        mark = "ok " if note is None else "BAD"
        bad += note is not None
        print(f"{mark} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only)'} {note or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
