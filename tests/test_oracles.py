"""Every registered query next to its DuckDB oracle on sf0.001 (row count, columns and an
order-insensitive value hash)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, digest

from conftest import SF_SMALL

OWN = {k for k in E.queries() if k != "pipeline" and not k.startswith("op")}
SQL = {k: v for k, v in E.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    o = con.execute(SQL[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert digest(s) == digest(o)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "rank" in df.columns


def test_every_query_has_an_oracle():
    assert OWN == set(SQL)
