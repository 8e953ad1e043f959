"""Runs queries beside their SQL and compares schema, row count and values.

    python -m tests.oracle /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return db


def compare(df, db, sql: str) -> list[str]:
    """Differences between a Spark result and a DuckDB result; empty when equal."""
    relation = db.sql(sql)
    spark_types = {name: TYPES.get(kind, kind) for name, kind in df.dtypes}
    duck_types = {name: str(kind) for name, kind in zip(relation.columns, relation.types)}
    problems = []
    if spark_types != duck_types:
        problems.append(f"schema: {spark_types} against {duck_types}")
    order = sorted(spark_types)
    ours = Counter(tuple(row[c] for c in order) for row in df.toArrow().to_pylist())
    theirs_table = relation.select(*[f'"{c}"' for c in order]) if set(order) == set(duck_types) else relation
    theirs = Counter(theirs_table.fetchall())
    if ours != theirs:
        problems.append(
            f"rows {sum(ours.values())} against {sum(theirs.values())};"
            f" only Spark {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
        )
    return problems


def main() -> None:
    from tests.conftest import make_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, db = make_session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            problems = compare(df, db, oracles[name]) if name in oracles else []
            rows = "" if name in oracles else f" rows={df.count()}"
        except Exception as error:  # report and go on with the next query
            problems, rows = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += [name] if problems else []
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok':4} {kind:4} {time.time() - start:6.1f}s {name}{rows}", *problems, flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
