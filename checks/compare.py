"""Run every query next to its SQL and report differences.

    python -m checks.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

from checks.oracle import ORACLE
from checks.queries import QUERIES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time(0) else v.isoformat()
    return str(v)


def rows(names: list[str], tuples) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(t[i]) for i in order) for t in tuples)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def compare(spark, con, sf_dir: str, name: str) -> list[str]:
    """Differences between a query and its SQL; empty when they agree."""
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return []
    result = con.sql(ORACLE[name])
    names = list(result.columns)
    want = rows(names, result.fetchall())
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} <> {sorted(names)}"]
    types = {n: str(t) for n, t in zip(names, result.types)}
    for column, kind in df.dtypes:
        if KINDS.get(kind) != types[column]:
            found.append(f"type of {column}: {kind} <> {types[column]}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} <> {len(want)}")
    mine, theirs = set(got) - set(want), set(want) - set(got)
    if mine or theirs:
        found.append(f"columns: {sorted(names)}")
        found += [f"spark {r}" for r in sorted(mine)[:4]] + [f"sql   {r}" for r in sorted(theirs)[:4]]
        found.append(f"{len(mine)} / {len(theirs)} differing rows")
    return found


def main() -> int:
    from sumtrail.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in wanted or QUERIES:
        start = time.time()
        try:
            found = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'DIFF' if found else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("     ", line)
    print(f"{bad} of {len(wanted or QUERIES)} differ; without SQL: {sorted(set(QUERIES) - set(ORACLE))}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
