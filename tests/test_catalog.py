import pytest
from compare import against_sql

from quillstack.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, data, name):
    against_sql(catalog.queries()[name](spark, data), catalog.oracle_sql()[name], data)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
