from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditloom.operators.orphan_refs import _groups, _heavy, orphan_counts, orphan_records

REFS = "table_name string, record_id long, ref_key long, at timestamp_ntz, id long, added_at string"
TARGETS = "id long, added_at timestamp_ntz, removed_at timestamp_ntz, last_checked timestamp_ntz, reason string"


def refs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], REFS)


def targets(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], TARGETS)


PACKAGES = [
    (1, dt(2023, 1, 1), None, dt(2025, 1, 1)),
    (1, dt(2023, 1, 1), dt(2024, 1, 1), None),  # outdated: NULL is oldest
    (2, dt(2023, 5, 15), None, dt(2025, 1, 1)),
    (2, dt(2023, 5, 15), None, dt(2025, 1, 1)),
    (3, dt(2023, 1, 1), dt(2024, 1, 1), dt(2025, 1, 1)),
    (None, dt(2023, 1, 1), None, dt(2025, 1, 1)),
]
ROWS = [
    ("a", 1, 1, dt(2023, 2, 1)), ("a", 2, 2, dt(2023, 5, 14)), ("a", 3, 2, dt(2023, 5, 15)), ("a", 4, 3, dt(2023, 2, 1)), ("a", 5, 9, dt(2023, 2, 1)), ("a", 6, None, dt(2023, 2, 1)),
    ("a", 7, 0, dt(2023, 2, 1)), ("b", 1, 2, None), ("b", 2, 9, None), ("b", 2, 9, None), ("b", 3, 2, dt(2023, 4, 1)), ("b", 4, -4, dt(2023, 4, 1)),
    (None, None, 2, dt(2023, 5, 2)), (None, 9, 2, dt(2023, 5, 20)),
]
FOUND = [("a", 2, "late"), ("a", 4, "deleted"), ("a", 5, "missing"), ("b", 2, "missing"), ("b", 2, "missing"), ("b", 3, "late"), ("b", 4, "missing"), (None, None, "late")]


@pytest.mark.parametrize("heavy_keys", [1, 4, 512])
def test_reasons(spark, heavy_keys):
    got = orphan_records(refs(spark, ROWS), targets(spark, PACKAGES), heavy_keys).collect()
    assert sorted(map(tuple, got), key=str) == sorted(FOUND, key=str)


@pytest.mark.parametrize("heavy_keys", [1, 3, 512])
def test_counts_agree_with_records(spark, heavy_keys):
    got = orphan_counts(refs(spark, ROWS), targets(spark, PACKAGES), heavy_keys).collect()
    assert sum(r.n_refs for r in got) == len(FOUND)
    assert {(r.table_name, str(r.period), r.reason): r.n_refs for r in got}[("a", "2023-05-01", "late")] == 1
    assert {(r.table_name, r.period, r.reason): r.n_refs for r in got}[("b", None, "missing")] == 2
    assert {(r.table_name, str(r.period), r.reason): r.n_refs for r in got}[(None, "2023-05-01", "late")] == 1


def test_empty(spark):
    assert orphan_records(refs(spark, []), targets(spark, PACKAGES)).count() == 0
    assert {r.reason for r in orphan_records(refs(spark, ROWS), targets(spark, [])).collect()} == {"missing"}
    assert orphan_counts(refs(spark, []), targets(spark, [])).count() == 0


def test_hot_key_is_bounded(spark):
    rows = [("a", i, 7, dt(2023, 1, 1)) for i in range(1000)] + [("a", 1000 + i, i + 100, dt(2023, 1, 1)) for i in range(1000)]
    assert _heavy(_groups(refs(spark, rows).withColumn("period", F.trunc("at", "month"))), 100) == [7]
    assert orphan_records(refs(spark, rows), targets(spark, PACKAGES), 100).count() == 2000
