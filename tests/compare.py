"""Run a registered query and its SQL side by side and compare names, types, rows and values."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(float(f"{value:.12g}") + 0.0)
    if isinstance(value, Decimal):
        return f"{value:f}"
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


_KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "int": "INTEGER"}


def differences(df, con, sql: str) -> list[str]:
    """Empty when both results agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    want = _rows(names, result.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(names) ^ set(df.columns))}"]
    for field in df.schema:
        kind = field.dataType.simpleString()
        if _KINDS.get(kind, kind.upper()) != kinds[field.name]:
            found.append(f"type {field.name}: {kind} / {kinds[field.name]}")
    if sum(got.values()) != sum(want.values()):
        found.append(f"rows {sum(got.values())} / {sum(want.values())}")
    if got != want:
        columns = sorted(names)
        extra, missing = list((got - want).elements()), list((want - got).elements())
        found.append(f"values: {len(extra)} rows differ of {sum(want.values())}")
        key = {r[columns.index("cust_id")]: r for r in missing} if "cust_id" in columns else {}
        for row in extra[:3]:
            other = key.get(row[columns.index("cust_id")]) if key else (missing[0] if missing else None)
            if other:
                found.append(str([(c, a, b) for c, a, b in zip(columns, row, other) if a != b][:6]))
    return found
