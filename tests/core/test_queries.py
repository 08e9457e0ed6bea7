"""Every registered query against its SQL in DuckDB, row by row."""

import datetime
import math

import duckdb
import pytest

from plumbline.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 7) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v.isoformat() if isinstance(v, datetime.date) else v
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    got = rows(df.columns, df.collect())
    assert got
    if name not in ORACLES:
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cur.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7) for x, y in zip(a, b, strict=True)), (a, b)
