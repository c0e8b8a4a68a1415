"""Compare registered queries with their SQL: python tests/oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    import numpy as np

    if v is None:
        return "null"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return "nan" if v != v else repr(float(v) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_plain(r[k]) for k in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return len(got) > 0, f"{took:6.2f}s rows={len(got)} (no SQL)"
    t0 = time.time()
    res = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    note = f"{took:6.2f}s sql={time.time() - t0:5.2f}s rows={len(got)}"
    if got_cols != want_cols:
        return False, f"{note} columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"{note} rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if kinds.get(t, types[c]) != types[c]]
    if odd:
        note += f" types {odd}"
    if bad:
        return False, f"{note} {len(bad)} rows differ, e.g. {bad[0]}"
    return True, note


def main() -> int:
    from repalign.plans import catalog
    from repalign.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name, fn in catalog.QUERIES.items():
        if args and not any(a in name for a in args):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, catalog.ORACLE.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
