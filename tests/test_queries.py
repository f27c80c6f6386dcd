"""Every query with an SQL twin gives the same rows over whole tables; the others run over them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("CAMBIUM_TEST_DATA", "/root/testdata/sf0.001")
CORE = [n for n in entry.queries() if n in entry.oracle_sql()]
OTHERS = [n for n in entry.queries() if n not in entry.oracle_sql()]


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, int)):
        return v
    if isinstance(v, float):
        return round(v, 6)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", CORE)
def test_sql_twin(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(map(plain, r)) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", OTHERS)
def test_runs_over_whole_tables(spark, name):
    rows = entry.queries()[name](spark, DATA).collect()
    assert rows and len({tuple(r.asDict()) for r in rows}) == 1
