"""Each query against its SQL counterpart on the smallest tables."""

import math
import os

import duckdb
import pytest

from marlstone.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    if isinstance(a, (list, tuple)):
        return b is not None and len(a) == len(b) and all(map(same, a, b))
    return a == b


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found), key=lambda r: tuple((x is not None, f"{x:.6f}" if isinstance(x, float) else str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in catalog.ORACLES:
        assert df.columns
        return
    answer = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in answer.description]
    want = rows(columns, answer.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert same(g, w), (g, w)
