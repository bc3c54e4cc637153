"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import math
import pathlib

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None when the results agree, else a text that says where they differ."""
    cursor = con.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(expected_names):
        return f"columns {sorted(df.columns)} != {sorted(expected_names)}"
    expected = _rows(expected_names, cursor.fetchall())
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    if len(found) != len(expected):
        return f"{len(found)} rows, expected {len(expected)}; first found {found[:1]}, expected {expected[:1]}"
    for a, b in zip(found, expected):
        if a != b:
            parts = [(n, x, y) for n, x, y in zip(sorted(df.columns), a, b) if x != y]
            return f"differ in {parts}"
    return None
