"""Run a registered query on Spark and its SQL twin on DuckDB, and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(canonical(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, name: str, query, sql: str | None, sf_dir: str) -> dict:
    start = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    out = {"name": name, "rows": len(got), "sec": round(took, 2), "ok": None, "why": ""}
    if sql is None:
        return out
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return out | {"ok": False, "why": f"columns {sorted(df.columns)} vs {sorted(names)}"}
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return out | {"ok": False, "why": f"rows {len(a)} vs {len(b)}: {a[:2]} {b[:2]}"}
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return out | {"ok": False, "why": f"{len(bad)} rows differ, first {bad[0]}"}
    return out | {"ok": True}


def main() -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from conftest import session

    sf = sys.argv[1]
    chosen = sys.argv[2:]
    spark = session()
    sqls = entry.oracle_sql()
    for name, q in entry.queries().items():
        if chosen and not any(c in name for c in chosen):
            continue
        try:
            r = compare(spark, name, q, sqls.get(name), f"/root/testdata/{sf}")
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "why": str(e)[:1500]}
        print({True: "ok  ", False: "FAIL", None: "rows"}[r["ok"]], name, r.get("rows"), r.get("sec"), r["why"], flush=True)


if __name__ == "__main__":
    main()
