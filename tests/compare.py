"""Compare a query with its SQL twin: columns, row count, types and values."""

from __future__ import annotations

import datetime
import glob
import math
import os
from decimal import Decimal

import duckdb

KINDS = {
    "bigint": "int64", "int": "int32", "double": "float64", "float": "float32",
    "string": "text", "boolean": "bool",
    "BIGINT": "int64", "INTEGER": "int32", "DOUBLE": "float64", "FLOAT": "float32",
    "VARCHAR": "text", "BOOLEAN": "bool",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df, con, sql: str) -> str | None:
    """What differs, or None."""
    relation = con.sql(sql)
    theirs, ours = relation.columns, df.columns
    if sorted(ours) != sorted(theirs):
        return f"columns {sorted(ours)} != {sorted(theirs)}"
    our_kinds = {n: KINDS.get(t, t) for n, t in df.dtypes}
    their_kinds = {n: KINDS.get(str(t), str(t)) for n, t in zip(theirs, relation.types)}
    if our_kinds != their_kinds:
        wrong = {n: (our_kinds[n], their_kinds[n]) for n in ours if our_kinds[n] != their_kinds[n]}
        return f"types {wrong}"
    left = _sorted_rows([tuple(r) for r in df.collect()], ours)
    right = _sorted_rows(relation.fetchall(), theirs)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows, first {bad[0]}" if bad else None
