"""Compare registered queries with their SQL on the given tables.

    python tests/parity.py [scale] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        out.append(tuple(repr(row[i]) for i in order))
    return sorted(columns), sorted(out)


def sql_rows(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    relation = con.execute(sql)
    columns = [c[0] for c in relation.description]
    return columns, relation.fetchall()


def compare(spark, name, query, sql, sf_dir):
    started = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {spent:.2f}s"
    started = time.time()
    columns, expected = sql_rows(sql, sf_dir)
    sql_spent = time.time() - started
    got_cols, got = canonical(rows, df.columns)
    exp_cols, exp = canonical(expected, columns)
    note = f"{len(got)} vs {len(exp)} rows, {spent:.2f}s vs {sql_spent:.2f}s"
    if got_cols != exp_cols:
        return False, f"columns {got_cols} vs {exp_cols}; {note}"
    if got != exp:
        diff = [(a, b) for a, b in zip(got, exp) if a != b][:3]
        return False, f"{note}; first differences {diff}"
    return True, note


def main():
    import __spark_entry__ as entry
    from barflow.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = local_session()
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if names and name not in names:
            continue
        try:
            ok, note = compare(spark, name, query, oracles.get(name), f"/root/testdata/sf{scale}")
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
