"""Compare a Spark result with the DuckDB oracle on the same parquet tables
(column names, row count, order-insensitive multiset of rows)."""

from __future__ import annotations

import datetime as dt
import math
import os

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, float):
        return (1, repr(float(v)))
    if isinstance(v, dt.datetime):
        return (1, v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return (1, v.isoformat())
    if isinstance(v, (bool, int)):
        return (1, str(v))
    if hasattr(v, "tolist"):
        return (1, repr(v.tolist()))
    if isinstance(v, (list, tuple)):
        return (1, repr(list(v)))
    return (1, str(v))


def compare(sdf, con, sql: str) -> tuple[bool, str]:
    cols = sdf.columns
    srows = sorted(tuple(norm(v) for v in r) for r in sdf.collect())
    rel = con.sql(sql)
    ocols = rel.columns
    if sorted(cols) != sorted(ocols):
        return False, f"columns differ: spark={cols} oracle={ocols}"
    idx = [ocols.index(c) for c in cols]
    orows = sorted(tuple(norm(r[i]) for i in idx) for r in rel.fetchall())
    if srows != orows:
        only_s = [r for r in srows if r not in set(orows)][:3]
        only_o = [r for r in orows if r not in set(srows)][:3]
        return False, f"rows differ ({len(srows)} vs {len(orows)}): spark-only {only_s} oracle-only {only_o}"
    return True, f"{len(srows)} rows"
