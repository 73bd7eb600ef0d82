"""Run registered queries and their DuckDB SQL side by side and compare every value.

    python tests/check_oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(got: list[tuple], want: list[tuple]) -> str | None:
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} instead of {b}"
    return None


def compare(spark, connection, sf_dir: str, query, sql: str) -> tuple[int, str | None]:
    frame = query(spark, sf_dir)
    got = canonical([tuple(row) for row in frame.collect()], frame.columns)
    cursor = connection.execute(sql)
    names = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    if sorted(names) != sorted(frame.columns):
        return len(got), f"columns {sorted(frame.columns)}, expected {sorted(names)}"
    wide = [name for name, kind in types.items() if "HUGEINT" in kind or "DECIMAL" in kind]
    if wide:
        return len(got), f"types of {wide} differ"
    return len(got), difference(got, canonical(cursor.fetchall(), names))


def main() -> int:
    import __spark_entry__ as registered
    from tripweave.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    queries, oracles = registered.queries(), registered.oracle_sql()
    assert set(oracles) <= set(queries)
    bad = 0
    for name in chosen or queries:
        start = time.time()
        if name not in oracles:
            if not chosen:
                continue
            rows = queries[name](spark, sf_dir).collect()
            print(f"rows  {name} {len(rows)} {rows[:14]} {time.time() - start:.1f}s", flush=True)
            continue
        try:
            count, problem = compare(spark, connection, sf_dir, queries[name], oracles[name])
        except Exception as error:  # report and go on with the next query
            count, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {count} rows {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
