"""Compare a Spark DataFrame with an oracle SQL result from DuckDB (test helper).

Columns are sorted by name, rows are sorted, floats are compared with a small
tolerance; the driver's own check is a value hash, so the helper also reports
exact mismatches.
"""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if hasattr(v, "tolist"):
        return tuple(v.tolist())
    if isinstance(v, list):
        return tuple(v)
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) if not isinstance(x, (int, float)) else (2, float(x))
                 for x in row)


def compare(spark_df, con, sql: str, rel_tol: float = 1e-9):
    """Return (ok, message)."""
    sp_cols = sorted(spark_df.columns)
    sp_rows = [tuple(_norm(r[c]) for c in sp_cols) for r in spark_df.select(*sp_cols).collect()]
    rel = con.sql(sql)
    dk_cols_orig = rel.columns
    dk_cols = sorted(dk_cols_orig)
    if dk_cols != sp_cols:
        return False, f"columns differ: spark={sp_cols} duck={dk_cols}"
    idx = [dk_cols_orig.index(c) for c in dk_cols]
    dk_rows = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    if len(sp_rows) != len(dk_rows):
        return False, f"row count differs: spark={len(sp_rows)} duck={len(dk_rows)}"
    sp_rows.sort(key=_key)
    dk_rows.sort(key=_key)
    exact = True
    for a, b in zip(sp_rows, dk_rows):
        for c, x, y in zip(sp_cols, a, b):
            if x == y:
                continue
            exact = False
            if isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool):
                if math.isclose(float(x), float(y), rel_tol=rel_tol, abs_tol=1e-9):
                    continue
            return False, f"value differs in {c}: spark={x!r} duck={y!r}\n spark row={a}\n duck row={b}"
    return True, "exact" if exact else "close"
