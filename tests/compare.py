"""Runs catalog queries beside their DuckDB SQL: names, types, row counts and values."""

from __future__ import annotations

import math
import os
import time

import duckdb

STRICT = bool(os.environ.get("COMPARE_STRICT"))
STAR = "region nation customer supplier part orders lineitem".split()
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in STAR:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _sort_key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _close(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (not STRICT and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))
    return a == b


def differences(spark, con, name: str, sf_dir: str, queries, oracles) -> str | None:
    df = queries[name](spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    order = sorted(types)
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=_sort_key)
    con.execute(oracles[name])
    found = {d[0]: str(d[1]) for d in con.description}
    if set(found) != set(types):
        return f"columns differ: only Spark {set(types) - set(found)}, only SQL {set(found) - set(types)}"
    wrong = {c: (types[c], found[c]) for c in order if KINDS.get(types[c]) != found[c]}
    listed = ", ".join(f'"{c}"' for c in order)
    want = sorted(con.execute(f"SELECT {listed} FROM ({oracles[name]})").fetchall(), key=_sort_key)
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if not all(_close(x, y) for x, y in zip(a, b)):
            return f"row {a} expected {b} ({order})"
    return f"types differ: {wrong}" if wrong else None


if __name__ == "__main__":
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from cyclelens.session import local_session

    folder = sys.argv[1]
    only = sys.argv[2:]
    session, connection = local_session(8), connect(folder)
    q, o = queries(), oracle_sql()
    print("queries without SQL:", sorted(set(q) - set(o)), "SQL without query:", sorted(set(o) - set(q)))
    bad = 0
    for key in only or q:
        if key not in o:
            continue
        begun = time.time()
        try:
            problem = differences(session, connection, key, folder, q, o)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - begun:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
