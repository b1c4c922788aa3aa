"""Compare registered queries with their SQL twins: ``python -m tests.harness [prefix ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
#: Queries that SQL cannot express; the tests hold them against brute force.
WITHOUT_TWIN = ("op", "pipeline")
SF_DIR = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got_cols, got = canonical(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = canonical([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        have, need = set(got), set(want)
        extra, missing = sorted(have - need)[:3], sorted(need - have)[:3]
        return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}", len(got)
    return None, len(got)


def main(prefixes):
    only = os.environ.get("TIDEMARK_MODULE")
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as e
    from tidemark.catalog import base
    from tidemark.session import local_session

    spark, con = local_session(8), connect()
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for key, fn in queries.items():
        if only and getattr(base.QUERIES.get(key), "__module__", "").rsplit(".", 1)[-1] != only:
            continue
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, SF_DIR)
            if key in oracles:
                problem, n = compare(df, con, oracles[key])
            else:
                n = len(df.collect())
                problem = None if key.startswith(WITHOUT_TWIN) else "no SQL twin"
        except Exception as ex:  # report and go on
            problem, n = f"{type(ex).__name__}: {str(ex)[:1500]}", -1
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {key} rows={n} {time.time() - t:.1f}s"
              f"{'' if key in oracles else ' (no oracle)'} {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
