import random
from datetime import datetime as dt
from datetime import timedelta

import pytest

from auditloom.operators.attribute_history import attribute_history, canonical_value, store

SCHEMA = "package_name string, property_key string, obs_id long, observed_at timestamp_ntz, value string, stable_for_n int, first_seen string, last_changed string, part string, seq string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = attribute_history(df, **more).collect()
    return sorted(((r.package_name, r.property_key, r.valid_from, r.valid_to, r.value, r.stable_for_n) for r in got), key=str)


def brute(rows):
    best = {}
    for r in rows:
        if r[4] is not None and r[3] is not None and (r[:2] + r[3:4] not in best or best[r[:2] + r[3:4]][2] < r[2]):
            best[r[:2] + r[3:4]] = r
    out, last = [], {}
    for r in sorted(best.values(), key=lambda r: (str(r[0]), r[1], r[3])):
        v = canonical_value(r[4])
        if last.get(r[:2], (None,))[0] != v:
            at = int(dt.fromisoformat(r[7]).timestamp())
            if r[:2] in last:
                out[last[r[:2]][1]][3] = at
            last[r[:2]] = (v, len(out))
            out.append([r[0], r[1], at, -1, r[4], r[5]])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("parts, every", [(1, 2), (3, 16), (13, 1)])
def test_against_brute_force(spark, parts, every):
    rng = random.Random(parts)
    rows = []
    for i in range(700):
        at = dt(2024, 1, 1) + timedelta(hours=rng.randint(0, 200))
        package = rng.choice(["hot", "hot", "hot", "p1", "p2", None])
        value = rng.choice(['["a","b"]', '["b", "a"]', "true", "TRUE", '"x"', " x ", "y", None, "y", "y"])
        rows.append((package, rng.choice(["k", "l"]), i, at, value, i, None, at.isoformat() + "+00:00"))
    assert run(spark, rows, parts=parts, checkpoint_every=every) == brute(rows)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_one_moment_over_many_partitions(spark, parts):
    """A third and more of the rows are of one moment: it is spread, and only its last row counts."""
    rows = [("p", "k", i, dt(2024, 1, 1) + timedelta(hours=i % 3), f"v{i % 3}", i, None, f"2024-01-01T0{i % 3}:00:00") for i in range(6)]
    rows += [("p", "k", 100 + i, dt(2024, 1, 2), f"w{i % 5}", i, None, f"2024-01-02T00:{i % 60:02}:00") for i in range(900)]
    rows += [("p", "k", None, dt(2024, 1, 2), "zz", 0, None, "2024-01-02T00:00:00"), ("p", "k", 5000, dt(2024, 1, 3), "w4", 0, None, "2024-01-03T00:00:00"), ("q", "k", 1, dt(2024, 1, 2), "w4", 0, None, "2024-01-02T00:00:00")]
    got = run(spark, rows, parts=parts, checkpoint_every=2)
    assert got == brute([r[:2] + ((r[2] if r[2] is not None else -1),) + r[3:] for r in rows])


def test_times_and_empty(spark):
    rows = [("p", "k", 1, dt(2024, 1, 1), "a", 0, None, "2024-01-01T00:30:00.75-04:30"), ("p", "k", 2, dt(2024, 1, 2), "b", 0, None, "2024-01-02 00:00:00"), ("p", "k", 3, dt(2024, 1, 3), "c", 0, None, "nonsense")]
    got = [r[2:4] for r in run(spark, rows)]
    assert got == [(1704085200, 1704153600), (1704153600, None), (None, -1)]
    assert run(spark, []) == []
    assert run(spark, [("p", "k", 1, None, "a", 0, None, None), ("p", "k", 1, dt(2024, 1, 1), None, 0, None, None)]) == []


def test_storage_holds_patches(spark):
    rows = [("p", "k", i, dt(2024, 1, 1) + timedelta(days=i), str(i), 0, "2024-01-01", "2024-01-01") for i in range(10)]
    kept = store(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), checkpoint_every=4, parts=1).where("row_kind <> 'edge'").orderBy("seq").collect()
    assert [r.row_kind for r in kept if r.part == 0] == ["checkpoint", "patch", "patch", "patch"] * 2 + ["checkpoint"]
    assert [(r.row_kind, r.value) for r in kept if r.part == 1] == [("checkpoint", "9")]
    kept = [r for r in kept if r.part == 0]
    assert kept[1].changed == ["value"] and kept[1].first_seen is None


@pytest.mark.parametrize("a, b, same", [('["a","b"]', ' [ "b","a","a"]', True), ("true", "TRUE", True), ('"x"', "x", True), ("x", "X", False), ('["a"]', "a", False), ("[broken", "[broken ", True), ('"100+"', "100+", True), ("", '""', True), ('"\\ud800"', '"\\ud801"', False), ('["\\ud800"]', '["\\ud800", "\\ud800"]', True)])
def test_canonical(a, b, same):
    assert (canonical_value(a) == canonical_value(b)) is same
    canonical_value(a).encode()
