"""Compare a named query with its check SQL on the same tables.

Run as a script: python tests/oracle.py [--sf 0.01] [name ...]
"""

import argparse
import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, float):
        return repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def _kinds(rows, columns):
    kinds = {}
    for name, i in sorted((c, i) for i, c in enumerate(columns)):
        kinds[name] = sorted({type(r[i]).__name__ for r in rows if r[i] is not None})
    return kinds


def compare(spark, con, sf_dir, fn, sql):
    """(problem or None, row count)"""
    frame = fn(spark, sf_dir)
    ours = [tuple(r) for r in frame.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", len(ours)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}", len(ours)
    if _kinds(ours, frame.columns) != _kinds(theirs, names):
        return f"types {_kinds(ours, frame.columns)} != {_kinds(theirs, names)}", len(ours)
    a, b = _rows(frame.columns, ours), _rows(names, theirs)
    if a != b:
        only = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(only)} of {len(a)} rows differ, first {only[0][0]} != {only[0][1]}", len(ours)
    return None, len(ours)


def main():
    import __spark_entry__ as entry
    from lunario.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        begin = time.time()
        try:
            if name in oracles:
                problem, n = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                n = len(queries[name](spark, sf_dir).collect())
                problem = None
        except Exception as error:  # report and go on with the rest
            problem, n = f"{type(error).__name__}: {str(error)[:1200]}", 0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name:28s} {n:7d} rows {time.time() - begin:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
