"""Compare a Spark query with its SQL twin in DuckDB on the same parquet files."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import time
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def digest(rows) -> str:
    return hashlib.sha256("\n".join("|".join(r) for r in rows).encode()).hexdigest()


def compare(spark_df, con, sql):
    """Return (ok, message)."""
    t0 = time.time()
    sc, sr = canon(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    took = time.time() - t0
    cur = con.execute(sql)
    dc, dr = canon([d[0] for d in cur.description], cur.fetchall())
    if sc != dc:
        return False, f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return False, f"rows {len(sr)} != {len(dr)}; e.g. {sorted(set(sr) ^ set(dr))[:4]}"
    if digest(sr) != digest(dr):
        a, b = sorted(set(sr) - set(dr)), sorted(set(dr) - set(sr))
        return False, f"{len(a)} of {len(sr)} rows differ\n  spark {sc} {a[:3]}\n  duck  {b[:3]}"
    if not sr:
        return False, "both empty"
    return True, f"{len(sr)} rows (spark {took:.2f}s)"
