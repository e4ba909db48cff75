"""Every query of the catalog against its SQL, and the driver's contract."""

import decimal
import math

import duckdb
import pytest

from lamina.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal | int | float) and not isinstance(v, bool):
        return "n", "nan" if isinstance(v, float) and math.isnan(v) else float(v)
    return "s", str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, small, oracle, name):
    df = catalog.QUERIES[name](spark, small)
    said = oracle.execute(catalog.ORACLES[name])
    columns = [d[0] for d in said.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in said.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want and want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_incremental_filter_reaches_the_scan(spark, small):
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in catalog.incremental_filter(spark, small)._jdf.queryExecution().executedPlan().toString()
