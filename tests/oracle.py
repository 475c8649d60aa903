"""Compare a query's rows with its SQL in DuckDB."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return int(v) if isinstance(v, (bool, int)) or isinstance(v, float) and v == int(v) else str(v)


def rows_of(found, cols):
    return sorted((tuple(map(plain, r)) for r in found), key=repr)


def compare(spark, query, sql):
    got = query(spark, SF)
    cols = sorted(got.columns)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    names = ", ".join(f'"{c}"' for c in cols)
    want = con.sql(f"SELECT {names} FROM ({sql})").fetchall()
    assert sorted(con.sql(sql).columns) == cols
    mine = got.select(*cols).toPandas().astype(object).values.tolist()
    assert rows_of(mine, cols) == rows_of(want, cols)
    assert want
