import pytest
from oracle import same

from tracelake import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, name):
    same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
