"""Run one registered query beside its DuckDB twin and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from catalogops.plans.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    got_columns = df.columns
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want_types = {d[0]: str(d[1]) for d in result.description}
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    want = rows_of(want_columns, result.fetchall())
    got = rows_of(got_columns, [tuple(r) for r in df.collect()])
    short = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = {
        c: (t, want_types[c])
        for c, t in df.dtypes
        if short.get(t, want_types[c]) != want_types[c]
    }
    if got != want:
        extra = list((got - want).items())[:3]
        missing = list((want - got).items())[:3]
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; only here {extra}; only there {missing}"
            f" ({sorted(got_columns)})"
        )
    if odd:
        return f"types {odd}"
    return None
