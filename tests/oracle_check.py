"""Run registered queries on Spark and their SQL on DuckDB and compare all rows.

    python tests/oracle_check.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(v)
    return str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(cell(r[i]) for i in order) for r in rows
    )


def compare(spark, con, name, folder, queries, oracles):
    """(ok, text) for one query; without SQL only the row count is reported."""
    df = queries[name](spark, folder)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return len(got) > 0, f"rows only: {len(got)}"
    rel = con.execute(oracles[name])
    want_cols, want = normal([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if got == want:
        return len(got) > 0, f"{len(got)} rows"
    extra, lost = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
    return False, f"{len(got)} rows, SQL {len(want)}; only Spark {extra}; only SQL {lost}"


def main():
    import __spark_entry__ as entry
    from tests.conftest import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = session(), connect(folder)
    names = [n for n in queries if not sys.argv[2:] or n.startswith(tuple(sys.argv[2:]))]
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, text = compare(spark, con, name, folder, queries, oracles)
        except Exception as e:
            ok, text = False, f"{type(e).__name__}: {str(e)[:600]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print(f"{len(names)} queries, {bad} failed")


if __name__ == "__main__":
    main()
