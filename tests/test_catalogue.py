"""Every query of the log engine against its SQL twin."""

import pytest

from siltwork import catalogue, catalogue_io
from tests.oracle_check import mismatch

SF = "/root/testdata/sf0.001"


QUERIES = catalogue.queries() | catalogue_io.queries()
SQL = catalogue.oracle_sql() | catalogue_io.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    query, sql = QUERIES[name], SQL.get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert mismatch(spark, SF, query, sql) is None
