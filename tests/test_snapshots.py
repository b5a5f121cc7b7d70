import random

from pyspark.sql import functions as F

from auditloom.functions.text import name_key, version_key
from auditloom.operators.snapshot_delta import snapshot_changes

SCHEMA = "snapshot_no int, delivery_no int, name string, version string, pair string, cells string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = snapshot_changes(df, name_key(F.col("name")), {"version": version_key(F.col("version")), "again": F.col("version")}).collect()
    return sorted((r.snapshot_no, r.name, r.change_kind, tuple(r.changed_fields)) for r in got)


def test_kinds(spark):
    rows = [
        (1, 1, " A ", "0:1"), (1, 1, "b", "1"), (1, 1, "c", None), (1, 1, "d", "2"), (1, 1, None, "9"), (1, 1, "", "1"),
        (3, 1, "a", "wrong"), (3, 2, "a", "1"), (3, 2, "a", "1"), (3, 2, "B\t", "1"), (3, 2, "c", "1"), (3, 2, "e", None), (3, 2, "", "1"),
        (4, 1, "a", "1"), (4, 1, "b", "1"), (4, 1, "c", "1"), (4, 1, "e", ""), (4, 1, "", "1"),
    ]
    assert run(spark, rows) == [
        (3, "a", "changed", ("again",)), (3, "c", "changed", ("again", "version")), (3, "d", "removed", ()), (3, "e", "added", ()), (4, "e", "changed", ("again", "version")),
    ]


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, "a", "1")]) == []


def test_conflicting_rows_compare_as_sets(spark):
    rows = [(1, 1, "a", "1"), (1, 1, "a", "2"), (2, 1, "a", "2"), (2, 1, "a", "1"), (3, 1, "a", "2")]
    assert run(spark, rows) == [(3, "a", "changed", ("again", "version"))]


def test_long_values_and_hot_name(spark):
    rows = [(1, 1, "x", "v" * 100_000)] * 500 + [(2, 1, "x", "v" * 100_000)] * 3
    assert run(spark, rows) == []


def test_more_snapshots_than_a_word_holds(spark):
    """Against a plain comparison of sets, over word borders, with the list of snapshots broadcast and joined."""
    rng = random.Random(5)
    held = {no: {n: rng.choice("12") for n in "abcde" if rng.random() < 0.8} for no in range(0, 400, 3)}
    rows = [(no, 1, n, v) for no, own in held.items() for n, v in own.items()]
    want, numbers = [], sorted(held)
    for before, no in zip(numbers, numbers[1:]):
        for n in "abcde":
            a, b = held[before].get(n), held[no].get(n)
            if a != b:
                want.append((no, n, "added" if a is None else "removed" if b is None else "changed"))
    df = spark.createDataFrame(rows, "snapshot_no int, delivery_no int, name string, version string")
    for most in (3, 1000):
        got = snapshot_changes(df, F.col("name"), {"version": F.col("version")}, most).collect()
        assert sorted((r.snapshot_no, r.name, r.change_kind) for r in got) == sorted(want)
