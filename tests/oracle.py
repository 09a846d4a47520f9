"""Hold a query against its SQL in DuckDB."""

import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def same(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = lambda rows: sorted(rows, key=lambda r: [(x is not None, str(type(x)), str(x)) for x in r])
    want = order([tuple(plain(v) for v in r) for r in found.fetchall()])
    got = order([tuple(plain(r[n]) for n in names) for r in df.collect()])
    assert got == want
