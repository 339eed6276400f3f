"""Every query of the engine against its SQL."""

import pytest

from prismlane.plans import catalogue

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    if name in catalogue.ORACLE_SQL:
        same_rows(df, duck.sql(catalogue.ORACLE_SQL[name]))
    else:
        assert df.count() > 0
