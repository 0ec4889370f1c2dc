"""Every registered query against its DuckDB oracle (sf0.001), as the driver checks."""

import duckdb
import pytest

import __spark_entry__ as E
from ferry.plans import suite
from scripts.compare import TABLES, digest, type_diffs

from tests.conftest import SF001

# the optional operators have tests of their own
NAMES = sorted(suite.registry())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(E.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    r = df.collect()
    assert len(r) == 1 and r[0].total_rows > 0
    assert df.columns == ["total_rows", "unique_users", "unique_events"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)
    assert type_diffs(df, res.description) == {}
