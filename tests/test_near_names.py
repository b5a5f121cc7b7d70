import random

from auditloom.operators import dependencies


def _osa(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_near_names_equal_brute_force(spark):
    """Short and long names, and some about as long as the limit between them, with letters changed, swapped, dropped and added."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abc\u00e9\U0001f600") for _ in range(n)) for n in (2, 3, 4, 5, 6, 7, 8, 9, 12, 22, 23, 24, 25, 26, 27, 40)]
    seen = {b: 100 for b in base}
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(t))
                kind = rng.randrange(4)
                t[i : i + 2] = [t[i : i + 2][::-1], [rng.choice("abc"), *t[i + 1 : i + 2]], t[i + 1 : i + 2], [rng.choice("abc"), *t[i : i + 2]]][kind]
                t = t or ["a"]
            seen.setdefault("".join(t), rng.choice([1, 9, 20]))
    best = {}
    for a, n in seen.items():
        k = 1 if len(a) < 8 else 2
        near = [(d, -m, b) for b, m in seen.items() if m >= 2 * n and abs(len(a) - len(b)) <= 2 and 0 < (d := _osa(a, b)) <= k]
        if len(a) >= 4 and near:
            best[a] = min(near)
    df = spark.createDataFrame(sorted(seen.items()), "name string, n long")
    got = {r.name: (r.target, r.distance) for r in dependencies.near_names(df, df, 2).collect()}
    assert len(best) > 60 and got == {a: (b, d) for a, (d, _, b) in best.items()}


def test_names_with_common_pieces_have_few_candidates(spark):
    """2,000 names of like length and ending: by their pieces all pairs are candidates."""
    rng = random.Random(4)
    made = {"".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) + "-utils" for _ in range(2000)}
    df = spark.createDataFrame([(x, 1) for x in sorted(made)], "name string, n long")
    assert dependencies.candidates(df, df, 1).count() < 20 * len(made)


def test_what_deletions_leave_is_not_broadcast(spark, tmp_path):
    """A small file of names: each gives hundreds of texts, which are not for the driver."""
    spark.createDataFrame([(f"name-number-{i:04}", 1) for i in range(50)], "name string, n long").write.parquet(f"{tmp_path}/names")
    df = spark.read.parquet(f"{tmp_path}/names")
    plan = dependencies.candidates(df, df, 1)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and ("rest#" in x or "piece#" in x)] and "SortMergeJoin" in plan
