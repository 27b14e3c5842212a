"""Every query with SQL gives the rows that DuckDB gives, on the small tables."""

import math

import duckdb
import pytest

from sylvan.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, str | int | bool) else round(float(v), 5)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    answer = con.execute(ORACLE_SQL[name])
    columns, rows = [c[0] for c in answer.description], answer.fetchall()
    assert sorted(columns) == sorted(got.columns)
    key = sorted(columns)
    mine = sorted((tuple(plain(r[c]) for c in key) for r in got.collect()), key=str)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in key) for r in rows), key=str)
    assert mine == theirs
