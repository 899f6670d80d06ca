"""Run registered queries next to their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) and not math.isnan(value):
        return float(f"{value:.12g}")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, otherwise the first difference."""
    df = query(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = _rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return f"{len(bad)} of {len(ours[1])} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from trajecta.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:] or list(entry.queries())
    spark = local_session(8, spark__driver__memory="8g")
    con = oracle_connection(sf_dir)
    for name in wanted:
        start = time.time()
        try:
            query, sql = entry.queries()[name], entry.oracle_sql().get(name)
            if sql is None:
                outcome = f"rows only: {query(spark, sf_dir).count()}"
            else:
                outcome = compare(spark, con, query, sql, sf_dir) or "ok"
        except Exception as error:  # one broken query must not hide the others
            outcome = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {outcome}", flush=True)
