"""Compare a query with its SQL twin the way the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math


def _cell(x):
    if hasattr(x, "tolist") and not isinstance(x, float):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([_cell(y) for y in x])
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return f"{x:.9g}" if math.isfinite(x) else str(x)
    if isinstance(x, bool):
        return str(x)
    return str(x)


def rows_of(rows: list[dict]) -> list[tuple]:
    return sorted((tuple(_cell(row[c]) for c in sorted(row)) for row in rows), key=str)


def mismatch(spark, sf_dir: str, query, sql: str) -> str | None:
    import duckdb

    con = duckdb.connect()
    import glob
    import os

    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    want = [dict(zip(names, row)) for row in done.fetchall()]
    found = query(spark, sf_dir)
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} instead of {sorted(names)}"
    a, b = rows_of(found.toArrow().to_pylist()), rows_of(want)
    if a != b:
        first = next(((x, y) for x, y in zip(a, b) if x != y), None)
        return f"{len(a)} rows, {len(b)} wanted; first difference {first}"
    return None
