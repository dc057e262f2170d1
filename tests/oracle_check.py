"""Run a registered query on Spark and its oracle on DuckDB, compare as multisets."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    con.execute("SET TimeZone='UTC'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, builder, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    df = builder(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    out = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols)}
    if out["cols_match"]:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        out["values_match"] = a == b
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            out["first_diffs"] = diff
            out["cols"] = sorted(s_cols)
    else:
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from mailspark import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_spark("local[8]")
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for n in (names or list(qs)):
        t = time.time()
        if n not in orc:
            c = qs[n](spark, sf).count()
            print(n, "rows-only", c, f"{time.time() - t:.1f}s", flush=True)
            continue
        try:
            r = compare(spark, n, qs[n], orc[n], sf, con)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "error": repr(e)[:600]}
        ok = r.get("values_match")
        bad += not ok
        print("OK " if ok else "BAD", r if not ok else n, f"{time.time() - t:.1f}s", flush=True)
    print("bad:", bad)
