"""Side-by-side run of registered queries and their SQL counterparts.

Usage: python -m tests.oracle SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _kind(value):
    return "null" if value is None else type(value).__name__


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in rows:
        out.append(tuple(r[i] for i in order))
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(_kind(v)), str(v)) for v in r))


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def compare(spark_df, con, sql):
    """Empty string when equal, else a short account of the first difference."""
    got_cols, got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}", len(got)
    for g, w in zip(got, want, strict=True):
        if not all(_same(x, y) for x, y in zip(g, w, strict=True)):
            return f"value {dict(zip(got_cols, zip(g, w)))}"[:900], len(got)
    return "", len(got)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from opsloom.session import local_session

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    oracles, bad = oracle_sql(), 0
    for name, build in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                diff, n = compare(df, con, oracles[name])
            else:
                diff, n = "", len(df.collect())
        except Exception as exc:  # report and go on with the next query
            diff, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        mark = "ok  " if not diff else "FAIL"
        bad += bool(diff)
        kind = "sql" if name in oracles else "rows"
        print(f"{mark} {name:34s} {kind} rows={n:<7d} {time.time() - t0:6.2f}s {diff}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
