"""Runs a registered query and its SQL twin on the same tables and compares all rows."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(plain(v) for v in x)
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows(names, data) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, con, sql: str) -> str:
    """An empty string, or what differs."""
    rel = con.sql(sql)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    diff = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(diff)} of {len(a)} differ, such as {diff[0]}" if diff else ""
