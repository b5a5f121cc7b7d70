"""Every query of the core runs; those with SQL give the same rows as DuckDB."""

import pytest

from auditloom.plans import audit, catalogue, cycle, detectors, problems, relational, streams
from tests.sqlcheck import assert_same

_QUERIES = {n: f for m in (relational, audit, catalogue, cycle, detectors, streams, problems) for n, f in m.QUERIES.items()}
_SQL = {n: s for m in (relational, audit, catalogue, cycle, detectors, streams, problems) for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(_QUERIES))
def test_query(name, spark, sf):
    if name in _SQL:
        assert_same(_QUERIES[name], _SQL[name], spark, sf)
    else:
        df = _QUERIES[name](spark, sf)
        assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(_QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
