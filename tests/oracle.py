"""Runs the catalogue's queries beside their DuckDB SQL and compares rows, in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else bool(v) if str(type(v)).endswith("bool'>") or str(type(v)).endswith("bool_'>") else v
    out = [tuple(clean(v.item() if hasattr(v, "item") else v) for v in r) for r in df.itertuples(index=False)]
    return sorted(out, key=repr)


def differ(spark_df, con, sql: str) -> str:
    """Empty if equal, else what differs first."""
    a, b = spark_df.toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows(a), rows(b)
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows"
    for p, q in zip(x, y):
        for u, v in zip(p, q):
            if isinstance(u, (int, float)) and isinstance(v, (int, float)):
                if abs(u - v) > 2e-5 * max(1, abs(u)) :
                    return f"{p} and {q}"
            elif u != v:
                return f"{p} and {q}"
    return ""
