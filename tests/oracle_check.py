"""Runs queries next to their SQL in DuckDB and compares names, types and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPE_NAMES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def differences(spark_df, con, sql: str) -> str:
    """Empty when both answers are the same set of rows."""
    cursor = con.execute(sql)
    types = {d[0]: TYPE_NAMES.get(str(d[1]), str(d[1])) for d in cursor.description}
    other = cursor.fetchall()
    mine_types = dict(spark_df.dtypes)
    if set(types) != set(mine_types):
        return f"columns {sorted(mine_types)} and {sorted(types)}"
    wrong = {c: (mine_types[c], types[c]) for c in types if mine_types[c] != types[c]}
    names = sorted(types)
    place = {c: i for i, c in enumerate(types)}
    mine = sorted((tuple(r[c] for c in names) for r in spark_df.select(*names).collect()), key=repr)
    rest = sorted((tuple(r[place[c]] for c in names) for r in other), key=repr)
    if len(mine) != len(rest):
        return f"{len(mine)} rows and {len(rest)} rows"
    bad = [(a, b) for a, b in zip(mine, rest) if a != b]
    if bad:
        only_a, only_b = sorted(set(mine) - set(rest), key=repr)[:2], sorted(set(rest) - set(mine), key=repr)[:2]
        return f"{len(bad)} of {len(mine)} rows differ: {names} spark {only_a} sql {only_b}"
    return f"types {wrong}" if wrong else ""


def main() -> int:
    from hearthpanel.session import local_session
    import __spark_entry__ as entry
    scale, names = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/{scale}"
    spark, con = local_session(8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            if name in oracles:
                problem = differences(queries[name](spark, folder), con, oracles[name])
            else:
                problem = "" if queries[name](spark, folder).collect() else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracles else '(rows only) '}{problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
