"""Side-by-side comparison of a Spark query and its DuckDB oracle."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def _kind(t: str) -> str:
    t = t.lower()
    for names, kind in ((("bigint", "long", "int64"), "long"), (("integer", "int32", "int"), "int"), (("varchar", "string"), "string"), (("double",), "double"), (("boolean", "bool"), "boolean")):
        if t in names:
            return kind
    return t.replace(" ", "").replace("timestamp_ntz", "timestamp")


def differences(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    """What differs, as text; nothing if names, types and the multiset of rows agree."""
    rel = con.sql(sql)
    mine, theirs = dict(spark_df.dtypes), dict(zip(rel.columns, map(str, rel.types), strict=True))
    if set(mine) != set(theirs):
        return [f"columns {sorted(mine)} and {sorted(theirs)}"]
    out = [f"type of {c}: {mine[c]} and {theirs[c]}" for c in mine if _kind(mine[c]) != _kind(theirs[c])]
    names = sorted(mine)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted((tuple(_plain(r[c]) for c in names) for r in spark_df.collect()), key=key)
    at = [rel.columns.index(c) for c in names]
    b = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    if len(a) != len(b):
        out.append(f"{len(a)} and {len(b)} rows")
    out += [f"{x} and {y}" for x, y in zip(a, b, strict=False) if x != y][:3]
    return out
