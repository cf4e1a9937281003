"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9)
    return value


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    con.close()
    return sorted(names), rows


def spark_rows(df) -> tuple[list[str], Counter]:
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in df.collect())


def difference(df, sql: str, sf_dir: str) -> str | None:
    """None when equal, else a short account of what differs."""
    want_names, want = sql_rows(sql, sf_dir)
    got_names, got = spark_rows(df)
    if want_names != got_names:
        return f"columns: sql {want_names}, spark {got_names}"
    if want != got:
        missing, extra = want - got, got - want
        return (
            f"{sum(want.values())} sql rows, {sum(got.values())} spark rows; "
            f"missing {list(missing)[:3]}, extra {list(extra)[:3]}"
        )
    return None
