import pytest

from auditloom.llm.queries import QUERIES, SQL
from tests.sqlcheck import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf):
    if name in SQL:
        assert_same(QUERIES[name], SQL[name], spark, sf)
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry_lists_them():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
