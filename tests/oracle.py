"""Run a query on Spark and its SQL twin on DuckDB and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM parquet_scan('{sf_dir}/{name}.parquet')")
    return con


def key(row):
    return tuple("" if v is None else (f"{v:.4e}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return abs(a - b) <= 2e-6 + 1e-9 * abs(b)
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    result = con.sql(sql)
    cols = sorted(df.columns)
    if cols != sorted(result.columns):
        return f"columns {cols} != {sorted(result.columns)}"
    for f in df.schema.fields:
        kind = str(dict(zip(result.columns, result.types))[f.name])
        simple = f.dataType.simpleString()
        want = {"bigint": ("BIGINT",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}.get(simple)
        if want and kind not in want:
            return f"type of {f.name}: {simple} vs {kind}"
    order = [result.columns.index(x) for x in cols]
    theirs = [tuple(r[i] for i in order) for r in result.fetchall()]
    ours = [tuple(r[x] for x in cols) for r in df.collect()]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}; first ours {ours[:1]} theirs {theirs[:1]}"
    ours.sort(key=key)
    theirs.sort(key=key)
    for x, y in zip(ours, theirs):
        if not all(same(p, q) for p, q in zip(x, y)):
            return f"{cols}: {x} != {y}"
    return None
