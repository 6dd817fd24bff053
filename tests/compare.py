"""Run registered queries beside their SQL twins and compare all rows.

python tests/compare.py <table folder> [query …]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return int(value) if float(value).is_integer() else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, name: str, query, sql: str | None, folder: str) -> tuple[str, int]:
    """An empty text if all rows agree, else what differs; and the row count."""
    df = query(spark, folder)
    found = rows_of(df.columns, df.collect())
    if sql is None:
        return "", sum(found.values())
    twin = con.execute(sql)
    columns = [c[0] for c in twin.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(columns)}", sum(found.values())
    wanted = rows_of(columns, twin.fetchall())
    if found == wanted:
        return "", sum(found.values())
    extra, missing = found - wanted, wanted - found
    return (
        f"{sum(extra.values())} rows too many, {sum(missing.values())} missing of {sum(wanted.values())}; "
        f"extra {list(extra)[:2]} missing {list(missing)[:2]}"
    ), sum(found.values())


if __name__ == "__main__":
    import __spark_entry__ as entry

    from seqset.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), duck(folder)
    sqls, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            problem, n = differences(spark, con, name, query, sqls.get(name), folder)
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += bool(problem)
        print(f"{'ok  ' if not problem else 'FAIL'} {name} rows={n} {time.time() - began:.1f}s {problem}", flush=True)
    print("failures:", bad)
