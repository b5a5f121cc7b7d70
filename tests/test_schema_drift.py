import doctest
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from auditloom.operators import schema_drift as sd

SCHEMA = "record_id long, feed string, table_name string, file_no int, line_no int, record_key long, delivered_at timestamp_ntz, payload string, fields string, compare_no int"


def frame(spark, rows):
    """rows: (file_no, record_key, payload)"""
    return spark.createDataFrame([(i, "f", "t", n, i, k, None, p if p is None or isinstance(p, str) else json.dumps(p), "clash", 1) for i, (n, k, p) in enumerate(rows)], SCHEMA)


def changes(spark, rows):
    got = sd.field_changes(sd.parsed_records(frame(spark, rows))).collect()
    return sorted((r.file_no, r.change_kind, r.field_name, r.new_name) for r in got)


def test_kinds(spark):
    rows = [(1, k, {"id": k, "name": f"n{k}", "old": f"v{k}", "gone": k}) for k in range(4)]
    rows += [(4, k, {"id": str(k), "name": None, "new": f"v{k}", "fresh": 1.5}) for k in range(4)]
    rows += [(5, k, {"id": str(k), "name": k, "new": f"v{k}", "fresh": 2.5}) for k in range(4)]
    rows += [(5, None, "{broken"), (5, None, ""), (5, None, None), (5, None, '{"a": 1} {"b": 2}'), (5, None, "[1]"), (5, None, '{"a": NaN}')]
    assert changes(spark, rows) == [(4, "added", "fresh", ""), (4, "removed", "gone", ""), (4, "renamed", "old", "new"), (4, "retyped", "id", ""), (5, "retyped", "name", "")]


def test_half_counts_and_strays_do_not(spark):
    rows = [(1, k, {"a": 1} | ({"b": 1} if k < 2 else {}) | ({"s": 1} if k == 0 else {})) for k in range(4)] + [(2, k, {"a": 1, "b": 2}) for k in range(4)]
    assert changes(spark, rows) == []


def test_case_matters_and_empty(spark):
    rows = [(1, k, {"A": k}) for k in range(3)] + [(2, k, {"a": k + 10}) for k in range(3)]
    assert changes(spark, rows) == [(2, "added", "a", ""), (2, "removed", "A", "")]
    assert changes(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_carry_over_blocks(spark, seed):
    """Types of all-null files and the file before, over block borders, against a plain scan."""
    rng = random.Random(seed)
    rows = [(n, k, {"id": k} | ({"v": rng.choice([None, 1, "x", 2.5])} if rng.random() < 0.7 else {})) for n in rng.sample(range(60), 40) for k in range(1)]
    got = {r.file_no: (r.prior_no, r.fields, r.prior_fields) for r in sd.file_schemas(sd.parsed_records(frame(spark, rows)), block=4).collect()}
    before, seen = None, {}
    for n, _, o in sorted(rows, key=lambda r: r[0]):
        seen |= {k: sd.json_type(v) for k, v in o.items() if v is not None}
        own = {k: seen.get(k) for k in o}
        prior = got[n][2]
        assert got[n][:2] == (before[0] if before else None, own)
        assert prior is None if before is None else {k: v for k, v in prior.items() if k in own} == {k: v for k, v in before[1].items() if k in own} and set(prior) == set(before[1])
        before = (n, own)


def test_records_of_no_file(spark):
    rows = [(i, f, t, n, i, 1, None, '{"a": 1}', "x", 1) for i, (f, t, n) in enumerate([(None, "t", 1), ("f", None, 1), ("f", "t", None), ("f", "t", 1), ("f", "t", 2)])]
    assert sd.parsed_records(spark.createDataFrame(rows, SCHEMA)).count() == 2


def brute(rows):
    files = defaultdict(list)
    for r in rows:
        o = sd.parse_object(r["payload"])
        if o is not None:
            files[(r["feed"], r["table_name"], r["file_no"])].append((r["record_key"], r["line_no"], o))
    out, groups = [], defaultdict(list)
    for f in files:
        groups[f[:2]].append(f[2])
    for g, numbers in groups.items():
        before, types = None, {}
        for no in sorted(numbers):
            records = files[(*g, no)]
            seen = Counter(k for _, _, o in records for k in o)
            now = {}
            for k in (k for k in seen if 2 * seen[k] >= len(records)):
                t = Counter(sd.json_type(o[k]) for _, _, o in records if o.get(k) is not None)
                if t:
                    types[k] = max(t, key=lambda x: (t[x], sd.JSON_TYPES.index(x)))
                now[k] = types.get(k)
            if before:
                gone, new = set(before[1]) - set(now), set(now) - set(before[1])
                values = lambda n, k: {rk: json.dumps(sd._level(o[k]), sort_keys=True) for rk, _, o in sorted(files[(*g, n)], key=lambda x: x[1]) if rk is not None and o.get(k) is not None}
                able = []
                for a in gone:
                    for b in new:
                        x, y = values(before[0], a), values(no, b)
                        both = set(x) & set(y)
                        same = sum(x[k] == y[k] for k in both)
                        if 2 * same > len(both):
                            able.append((-same / len(both), a, b))
                for _, a, b in sorted(able):
                    if a in gone and b in new:
                        gone.remove(a)
                        new.remove(b)
                        out.append((*g, no, "renamed", a, b))
                out += [(*g, no, "removed", a, "") for a in gone] + [(*g, no, "added", a, "") for a in new]
                out += [(*g, no, "retyped", k, "") for k in now if now[k] and before[1].get(k) and now[k] != before[1][k]]
            before = (no, now)
    return sorted(out)


def test_found_against_brute_force(spark):
    records = spark.read.parquet("/root/testdata/sf0.01/seed_records.parquet")
    got = sd.field_changes(sd.parsed_records(records)).select("feed", "table_name", "file_no", "change_kind", "field_name", "new_name").collect()
    assert sorted(map(tuple, got)) == brute([r.asDict() for r in records.collect()])


def test_unified_table(spark):
    rows = [(1, k, {"id": k, "old": f"v{k}", "record_id": 5, "Id": k}) for k in range(3)] + [(2, k, {"id": k + 0.5, "new": f"v{k}", "record_id": 6, "stray": 1} if k == 0 else {"id": 1.5, "new": f"v{k}", "record_id": 6}) for k in range(3)]
    table = sd.unified_table(frame(spark, [*rows, (2, 9, "broken")]), "t")
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    assert kinds["Id"] == "bigint" and kinds["id__2"] == "double" and kinds["record_id__2"] == "bigint" and "old" not in kinds or "new" not in kinds
    assert table.count() == 6 and table.where(F.col("strays").isNotNull()).count() == 1
    named = next(c for c in ("old", "new") if c in kinds)
    assert sorted(r[named] for r in table.collect()) == ["v0", "v0", "v1", "v1", "v2", "v2"]


def test_odd_json(spark):
    deep = '{"a": ' + "[" * 100_000 + "]" * 100_000 + "}"
    rows = [(1, k, {"a": "x"}) for k in range(3)] + [(2, 1, '{"a": "\\ud800", "k\\udc00": 1}'), (2, 2, '{"a": "' + "y" * 2_000_000 + '"}'), (2, 3, deep), (2, 4, '{"a": 123456789012345678901234567890}'), (2, 5, '{"a": 1e999}')]
    assert changes(spark, rows) == []
    assert sd.unified_table(frame(spark, rows), "t").count() == 7
    assert doctest.testmod(sd).failed == 0


def test_promotion_in_expressions(spark):
    from functools import reduce
    from itertools import combinations

    sets = [list(c) for k in range(4) for c in combinations(sorted(sd.JSON_TYPES), k)]
    for r in spark.createDataFrame([(c,) for c in sets], "t array<string>").select("t", sd.promoted(F.col("t")).alias("w")).collect():
        assert r.w == (reduce(sd.promote, r.t, None) or "string")


def test_promotion():
    for a in (None, *sd.JSON_TYPES):
        for b in (None, *sd.JSON_TYPES):
            assert sd.promote(a, b) == sd.promote(b, a)
            assert sd.promote(a, a) == a
