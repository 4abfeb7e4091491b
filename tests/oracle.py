"""Runs a query and its SQL side by side and compares columns, rows and values, whatever their order."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v if v is None or isinstance(v, (str, int, bool)) else str(v)


def difference(frame, sql, con):
    """None if both give the same; else what differs."""
    names = sorted(frame.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in frame.select(*names).collect()), key=repr)
    cursor = con.execute(sql)
    theirs_names = [c[0] for c in cursor.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b and not all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True))]
    return f"{len(wrong)} rows, such as {wrong[0]}" if wrong else None
