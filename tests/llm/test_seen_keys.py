import random
from datetime import datetime as dt
from datetime import timedelta

import numpy as np
import pytest

from auditloom.llm import seen_keys as sk

SCHEMA = "table_name string, record_id long, at timestamp_ntz, key string, kind string, h1 string"
SOURCES = ["s", "t"]


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def seeds(spark, rows):
    return spark.createDataFrame(rows, "table_name string, key string")


def brute(rows, known):
    seen, out = set(known), []
    for r in sorted(rows, key=lambda r: (r[2] or dt.min, r[1])):
        if r[3] and r[0] in SOURCES:
            if (r[0], r[3]) in seen:
                out.append(r[:2])
            seen.add((r[0], r[3]))
    return sorted(out)


@pytest.mark.parametrize("rate, shards", [(1e-3, 3), (0.3, 1), (0.5, 4)])
def test_against_brute_force(spark, rate, shards):
    rng = random.Random(shards)
    rows = []
    for i in range(4000):
        key = rng.choice(["hot", None, "", f"k{rng.randint(0, 3000)}"])
        rows.append((rng.choice([*SOURCES, "other"]), i, None if i % 97 == 0 else dt(2024, 1, 1) + timedelta(minutes=rng.randint(0, 900)), key))
    known = [("s", "k1"), ("s", "k1"), ("t", "k2"), ("t", None), (None, "k3")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200)
    try:
        got = sk.seen_records(records(spark, rows), seeds(spark, known), SOURCES, rate, shards).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == brute(rows, [k for k in known if k[0] and k[1]])


def test_wrong_marks_are_measured(spark):
    rows = [("s", i, dt(2024, 1, 1) + timedelta(seconds=i), f"k{i}") for i in range(6000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        r = sk.error_rates(records(spark, rows), seeds(spark, []), SOURCES, rate=0.2, shards=1).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(r) == 1 and r[0].n_records == 6000 and r[0].n_marked == r[0].n_wrong > 0
    assert 0 < r[0].absent_rate <= 0.2 and 0 < r[0].wrong_rate <= 0.2 and r[0].n_absent == 6000


def test_empty_and_ties(spark):
    assert sk.seen_records(records(spark, []), seeds(spark, []), SOURCES).count() == 0
    at = dt(2024, 1, 1)
    rows = [("s", 5, at, "k"), ("s", 2, at, "k"), ("s", 9, at, "k"), ("t", 1, at, "k"), ("s", 7, at, "x" * 1_000_000)]
    assert sorted(map(tuple, sk.seen_records(records(spark, rows), seeds(spark, []), SOURCES).collect())) == [("s", 5), ("s", 9)]


def test_state_carries_over(spark):
    at = dt(2024, 1, 1)
    first = [("s", i, at, f"k{i}") for i in range(9000)]
    kept = sk.marks(records(spark, first), seeds(spark, []), SOURCES, shards=2, keep_state=True)
    second = [("s", 10_000 + i, at, f"k{i + 8000}") for i in range(2000)]
    got = sk.marks(records(spark, second), seeds(spark, []), SOURCES, shards=2, state=kept).collect()
    marked = {r.record_id for r in got if r.verdict in (sk.MARKED, sk.SURE)}
    assert set(range(10_000, 11_000)) <= marked and len(marked) < 1020


def test_found_is_exact_with_carried_state(spark):
    """Two deliveries, the second with the filters of the first, at a rate at which many marks are wrong."""
    at = dt(2024, 1, 1)
    first = [("s", i, at, f"k{i}") for i in range(3000)]
    second = [("s", 10_000 + i, at, f"k{2500 + i // 2}") for i in range(3000)] + [("t", 1, at, "k1"), ("t", 2, at, "k1")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        kept = sk.marks(records(spark, first), seeds(spark, [("s", "k2999")]), SOURCES, rate=0.3, shards=2, keep_state=True)
        got = sk.seen_records(records(spark, second), seeds(spark, []), SOURCES, rate=0.3, shards=2, earlier=kept).collect()
        rates = {r.table_name: r for r in sk.error_rates(records(spark, second), seeds(spark, []), SOURCES, rate=0.3, shards=2, earlier=kept).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [r for r in brute(first + second, []) if r[1] >= 10_000 or r[0] == "t"]
    assert rates["s"].n_wrong > 0 and rates["s"].absent_rate <= 0.35


@pytest.mark.parametrize("rate", [0.1, 1e-2, 1e-3])
def test_filter_keeps_its_rate(rate):
    rng = np.random.default_rng(1)
    chain = sk.FilterChain(rate, first=500)
    own = rng.integers(0, 2**64, (20_000, 2), dtype=np.uint64)
    for part in np.array_split(own, 40):
        chain.add(part[:, 0], part[:, 1])
    assert chain.has(own[:, 0], own[:, 1]).all()
    other = rng.integers(0, 2**64, (50_000, 2), dtype=np.uint64)
    assert chain.has(other[:, 0], other[:, 1]).mean() <= rate * 1.1
    assert sum(level.words.nbytes for level in chain.levels) * 8 / 20_000 < 100
