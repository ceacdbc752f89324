"""Compare a Spark result with DuckDB's over the same Parquet tables."""

import math
from pathlib import Path

import duckdb


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}"
    if v is None:
        return "\0null"
    return f"{type(v).__name__}:{v}"


def _rows(rows, order):
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both hold the same columns and the same rows, in any order."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns: spark {sorted(df.columns)} oracle {sorted(names)}"]
    order = sorted(names)
    actual = df.collect()
    ours = _rows(actual, [df.columns.index(n) for n in order])
    theirs = _rows(expected, [names.index(n) for n in order])
    found = []
    if len(ours) != len(theirs):
        found.append(f"rows: spark {len(ours)} oracle {len(theirs)}")
    if ours != theirs:
        a, b = set(ours), set(theirs)
        found.append(f"{order}\n only spark {sorted(a - b)[:3]}\n only oracle {sorted(b - a)[:3]}")
    return found
