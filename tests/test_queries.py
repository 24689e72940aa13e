import duckdb
import pytest

from skein.plans import catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(values):
    return sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else repr(v) for v in r) for r in values)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*cols).collect())
    want = duck.execute(f'select {", ".join(chr(34) + c + chr(34) for c in cols)} from ({catalog.ORACLE_SQL[name]})').fetchall()
    assert got == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
