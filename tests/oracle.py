"""Compare a query with its SQL twin: rows, columns and values, in any order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(frame, con, sql: str) -> list[str]:
    """Empty if both sides agree, else what is different."""
    mine = frame.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    out = []
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    if len(mine) != len(theirs):
        out.append(f"rows {len(mine)} != {len(theirs)}")
    a, b = _bag(frame.columns, mine), _bag(names, theirs)
    if a != b:
        out.append(f"only in spark ({sum((a - b).values())}): {list((a - b).items())[:3]}")
        out.append(f"only in sql ({sum((b - a).values())}): {list((b - a).items())[:3]}")
    return out
