"""Compare registered queries with their SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (1, f"{float(v):.9f}")
    return (2, str(v))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_key(r[i]) for i in order) for r in rows])


def differences(spark_df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    got = [tuple(r) for r in spark_df.collect()]
    out = []
    if sorted(names) != sorted(spark_df.columns):
        out.append(f"columns {sorted(spark_df.columns)} vs {sorted(names)}")
        return out
    if len(got) != len(want):
        out.append(f"rows {len(got)} vs {len(want)}")
    a, b = _rows(spark_df.columns, got), _rows(names, want)
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    if only_a or only_b:
        out.append(f"{len(only_a)} / {len(only_b)} rows differ: {only_a[:2]} vs {only_b[:2]}")
    elif a != b:
        out.append("multiplicities differ")
    return out
