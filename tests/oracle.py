"""Compare registered queries with DuckDB: ``python tests/oracle.py [sf] [key ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from skarn.catalog.adapters import TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = [tuple(norm(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(keyed, key=lambda r: tuple((c is None, c or "") for c in r))


def oracle_rows(folder, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    res = con.execute(sql)
    return rows([d[0] for d in res.description], res.fetchall())


def compare(spark, folder, key, query, sql):
    df = query(spark, folder)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ("rows", f"{len(got)} rows")
    want_cols, want = oracle_rows(folder, sql)
    if got_cols != want_cols:
        return ("FAIL", f"columns {got_cols} != {want_cols}")
    if len(got) != len(want):
        return ("FAIL", f"rows {len(got)} != {len(want)}; first {got[:1]} / {want[:1]}")
    extra, missing = Counter(got) - Counter(want), Counter(want) - Counter(got)
    if extra or missing:
        return ("FAIL", f"{extra.total()} of {len(got)} differ: {min(extra)} / {min(missing)}")
    return ("ok" if got else "EMPTY", f"{len(got)} rows")


def main(argv):
    import __spark_entry__ as entry
    from skarn.session import local_session

    folder = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = local_session()
    q, o = entry.queries(), entry.oracle_sql()
    keys = argv[1:] or list(q)
    count = {}
    for key in keys:
        t0 = time.time()
        try:
            state, note = compare(spark, folder, key, q[key], o.get(key))
        except Exception as exc:  # report and go on with the next query
            state, note = "ERROR", str(exc).strip()[:600]
        count[state] = count.get(state, 0) + 1
        print(f"{state:5} {key:28} {time.time() - t0:6.2f}s  {note[:700]}", flush=True)
    print(count)


if __name__ == "__main__":
    main(sys.argv[1:])
