"""Every registered query runs over its whole tables; where SQL exists, DuckDB must give the same rows."""
import pytest

import __spark_entry__ as entry
from compare import compare, duck, run_duck, run_spark

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, sf_dir, name):
    got = run_spark(entry.queries()[name](spark, sf_dir))
    assert got[1], "no rows"
    if name in SQL:
        assert compare(got, run_duck(con, SQL[name])) == []
