"""Every registered query of the timeline engine against its SQL twin."""

from __future__ import annotations

import pytest

from kinograph import catalogue
from tests.oracle import DATA, assert_same


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, str(DATA))
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert_same(df, sql)
    else:
        assert df.count() > 0
