import random

import pyarrow as pa

from auditloom.operators import graph


def _exposed(edges, marked, hops, least):
    """By brute force."""
    out = {}
    for s in {a for a, _ in edges}:
        seen, front = {s}, {s}
        for k in range(1, hops + 1):
            front = {b for a, b in edges if a in front} - seen
            seen |= front
            if k >= least and front & marked:
                out[s] = (min(front & marked), k)
                break
    return out


def test_exposure_equals_brute_force(spark):
    rng = random.Random(5)
    for n, m, share, hops, least in ((12, 30, 0.5, 3, 2), (30, 60, 0.3, 3, 2), (30, 60, 0.2, 4, 3), (20, 40, 0.3, 3, 1), (24, 260, 0.9, 4, 2), (10, 20, 0.5, 1, 2)):
        edges = {(a, b) for a, b in ((f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)) if a != b}
        marked = {f"n{i:02}" for i in range(n) if rng.random() < share}
        got = graph.exposure(spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(x,) for x in sorted(marked)] + [(None,)], "node string"), hops, least)
        assert {r.src: (r.via, r.distance) for r in got.collect()} == _exposed(edges, marked, hops, least)


def _staged_rows(monkeypatch, counts):
    """Notes the rows of every table that the graph operators stage."""
    stage = graph.stage_table

    def counted(df, *a):
        out = stage(df, *a)
        counts.append(out.count())
        return out

    monkeypatch.setattr(graph, "stage_table", counted)


def test_exposure_over_a_hub_stages_no_pairs(spark, monkeypatch):
    """300 sources lead to a hub that leads to 300 marked nodes: 600 edges, 90,000 pairs."""
    counts: list[int] = []
    _staged_rows(monkeypatch, counts)
    edges = [(f"s{i:03}", "hub") for i in range(300)] + [("hub", f"t{i:03}") for i in range(300)]
    marked = spark.createDataFrame([(f"t{i:03}",) for i in range(300)], "node string")
    got = graph.exposure(spark.createDataFrame(edges, "src string, dst string"), marked, 3).collect()
    assert {(r.src, r.via, r.distance) for r in got} == {(f"s{i:03}", "t000", 2) for i in range(300)}
    assert max(counts) <= 1200


def test_exposure_of_a_source_with_many_marked_neighbours_stages_no_pairs(spark, monkeypatch):
    """A library leads to 300 users, most of them marked, these to a second library and that to 300 more: only the third hop leads to a new marked node."""
    counts: list[int] = []
    _staged_rows(monkeypatch, counts)
    near, far = [f"u{i:03}" for i in range(300)], [f"w{i:03}" for i in range(300)]
    edges = [("lib", u) for u in near] + [(u, "other") for u in near] + [("other", w) for w in far]
    marked = near[:280] + far
    got = graph.exposure(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(x,) for x in marked], "node string"), 3).collect()
    assert {(r.src, r.via, r.distance) for r in got} == {("lib", "w000", 3)} | {(u, "w000", 2) for u in near}
    assert max(counts) <= 1800


def _shuffled(spark) -> dict[int, int]:
    """Rows that each stage wrote to shuffles, of the latest stages."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {x.stageId(): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


def _users_of_marked_libraries():
    """600 users, each of 9 of 18 libraries, all of which are marked and lead back to their users: the third hop leads to the other libraries, the second to none."""
    rng = random.Random(3)
    libraries = [f"lib{i:02}" for i in range(18)]
    uses = [(f"u{i:03}", x) for i in range(600) for x in rng.sample(libraries, 9)]
    return {e for a, b in uses for e in ((a, b), (b, a))}, set(libraries)


def test_exposure_of_users_of_marked_libraries_shuffles_no_pairs(spark):
    """10,800 edges, 360,000 pairs of users."""
    edges, marked = _users_of_marked_libraries()
    earlier = _shuffled(spark)
    got = graph.exposure(spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(x,) for x in marked], "node string"), 3).collect()
    assert len(got) == len({r.src for r in got}) and {r.src: (r.via, r.distance) for r in got} == _exposed(edges, marked, 3, 2)
    assert sum(n for k, n in _shuffled(spark).items() if k not in earlier) < 150_000


def test_exposure_of_many_marked_neighbours_equals_brute_force(spark, monkeypatch):
    """Sources with many marked neighbours, by walking and by the search."""
    edges, marked = _users_of_marked_libraries()
    edges = {e for e in edges if not e[0].startswith("u") or e[0] < "u060"} | {("u000", "x"), ("x", "aé"), ("x", "a"), ("lib00", "aé")}
    marked |= {"a", "aé"}
    want = _exposed(edges, marked, 3, 2)
    for most in (10, 4_000_000):
        monkeypatch.setattr(graph, "_MOST_EDGES", most)
        got = graph.exposure(spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(x,) for x in marked], "node string"), 3).collect()
        assert {r.src: (r.via, r.distance) for r in got} == want


def test_search_of_several_blocks_equals_brute_force(spark):
    """600 sources in two blocks, and both blocks in one partition in any order, as adaptive execution may put them."""
    rng = random.Random(11)
    edges = {(f"n{rng.randrange(600):03}", f"n{rng.randrange(600):03}") for _ in range(2400)}
    edges = {(a, b) for a, b in edges if a != b}
    marked = {f"n{i:03}" for i in range(0, 600, 7)}
    want = {(s, *x) for s, x in _exposed(edges, marked, 4, 2).items()}
    df, marks = spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([(x,) for x in sorted(marked)], "node string")
    got = graph._searched(df.selectExpr("src AS node").distinct(), 600, df, marks, 4, 2).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    rows = [(*e, k) for k in (0, 1) for e in edges] + [(x, None, k) for k in (0, 1) for x in marked] + [(None, s, i % 2) for i, s in enumerate({a for a, _ in edges})]
    rng.shuffle(rows)
    table = pa.table(dict(zip(("src", "dst", "block"), zip(*rows))), pa.schema([("src", pa.string()), ("dst", pa.string()), ("block", pa.int32())]))
    for size in (1, 1000, len(rows)):
        got = [tuple(r.values()) for x in graph._nearest(4, 2)(iter(table.to_batches(size))) for r in x.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_closure_over_a_hub_stages_no_pairs(spark, monkeypatch):
    counts: list[int] = []
    _staged_rows(monkeypatch, counts)
    edges = [(f"s{i:03}", "hub") for i in range(300)] + [("hub", f"t{i:03}") for i in range(300)]
    got = graph.closure(spark.createDataFrame(edges, "src string, dst string"), 3)
    assert {tuple(r) for r in got.select("src", "dst", "distance").collect()} == {(a, b, 1) for a, b in edges} | {(f"s{i:03}", f"t{j:03}", 2) for i in range(300) for j in range(300)}
    assert max(counts) <= 600


def test_closure_by_bits_equals_joins(spark, monkeypatch):
    rng = random.Random(7)
    edges = {(a, b) for a, b in ((f"n{rng.randrange(600):03}", f"n{rng.randrange(600):03}") for _ in range(1200)) if a != b}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    bits = graph.closure(df, 3).select("src", "dst", "distance").collect()
    monkeypatch.setattr(graph, "_MOST_EDGES", 10)
    joins = graph.closure(df, 3).select("src", "dst", "distance").collect()
    assert len(bits) == len(set(bits)) and set(bits) == set(joins)
