"""Compare a Spark result with DuckDB SQL over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    cursor = con.execute(sql)
    names, types = [d[0] for d in cursor.description], {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    order = sorted(names)
    got = _sorted(tuple(_value(r[c]) for c in order) for r in df.collect())
    assert got == _sorted(tuple(_value(r[names.index(c)]) for c in order) for r in expected)
