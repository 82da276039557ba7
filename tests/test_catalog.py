"""Registered queries equal their SQL."""

import os

import duckdb
import pytest

from wardlight.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in os.listdir(SF):
        c.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{SF}/{p}{'/*.parquet' if os.path.isdir(f'{SF}/{p}') else ''}'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[columns].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["user_id", "first_us", "trigger_us", "last_us", "n"]
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_parsers_stay_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes: rows of one that is larger are interpreted."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    for name in ("kv_parse", "parse_auth", "parse_firewall", "url_split"):
        code = debug.codegenStringSeq(catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan())
        assert max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())) < 8000, name
