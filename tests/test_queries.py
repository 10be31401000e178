"""Every registered territorial query against its SQL, on the smallest tables."""

import pytest
from conftest import SMALL, same

from parcelwise import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, SMALL).toPandas()
    if name in SQL:
        same(found, duck.execute(SQL[name]).df())
    else:
        assert len(found)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())
