import pytest

from termloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.SQL[name])
