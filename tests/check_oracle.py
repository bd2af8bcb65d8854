"""Compare registered queries with their SQL: ``python tests/check_oracle.py [sf_dir] [names...]``."""

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
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
}


def canonical(names: list[str], rows: list[tuple]) -> list[str]:
    """Rows as sorted text, columns by name."""

    def text(value):
        return f"{value:.6f}" if isinstance(value, float) else repr(value)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("\x1f".join(text(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> tuple[str, str]:
    start = time.time()
    frame = query(spark, sf_dir)
    found = [tuple(row) for row in frame.collect()]
    detail = f"{len(found)} rows, {time.time() - start:.1f}s"
    if sql is None:
        return "rows only", detail
    start = time.time()
    cursor = con.execute(sql)
    names = [column[0] for column in cursor.description]
    expected = cursor.fetchall()
    detail += f", sql {time.time() - start:.1f}s"
    mine_types = dict(frame.dtypes)
    sql_types = {c[0]: KINDS.get(str(c[1]), str(c[1])) for c in cursor.description}
    if sorted(mine_types) != sorted(sql_types):
        return "COLUMNS", f"{sorted(mine_types)} != {sorted(sql_types)}"
    mine, theirs = canonical(frame.columns, found), canonical(names, expected)
    if mine != theirs:
        only = sorted(set(mine) - set(theirs))[:2], sorted(set(theirs) - set(mine))[:2]
        return "DIFFERS", f"{detail} of {len(theirs)}: {only}"
    if mine_types != sql_types:
        other = {k: (v, sql_types[k]) for k, v in mine_types.items() if v != sql_types[k]}
        return "TYPES", f"{detail} {other}"
    return "ok", detail


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from refsieve.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con, sql = local_session(8), connect(sf_dir), oracle_sql()
    bad = 0
    for name, query in queries().items():
        if chosen and name not in chosen:
            continue
        try:
            status, detail = compare(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as error:
            status, detail = "ERROR", str(error)[:800]
        bad += status not in ("ok", "rows only")
        print(f"{name:34} {status:12} {detail}", flush=True)
    print(f"{bad} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
