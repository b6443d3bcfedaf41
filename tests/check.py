"""Run registered queries next to their SQL and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    oc, orr = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sc != oc:
        return f"columns {sc} != {oc}", len(sr)
    if len(sr) != len(orr):
        return f"rows {len(sr)} != {len(orr)}", len(sr)
    for a, b in zip(sr, orr):
        if a != b:
            return f"value {a} != {b}", len(sr)
    return None, len(sr)


def main(names, sf="0.01"):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from codelattice.session import local_session

    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                err, n = compare(df, con, oracles[name])
            else:
                err, n = None, len(df.collect())
        except Exception as exc:  # noqa: BLE001
            err, n = f"{type(exc).__name__} {str(exc)[:700]}", -1
        bad += bool(err)
        mark = "BAD " if err else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:32s} {n:8d} {time.time() - t:6.2f}s {err or ''}"[:900], flush=True)
    print("failed", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "0.01"
    if args and args[0].startswith("sf="):
        sf = args.pop(0)[3:]
    main(args, sf)
