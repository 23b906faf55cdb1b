"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quireworks.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(cell(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert got[0]
        return
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = db.execute(ORACLES[name])
    want = table([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
