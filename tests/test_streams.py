from auditloom.plans.streams import watch_windows
from auditloom.streaming import cycles


def test_windows_count_every_event(spark, sf, tmp_path):
    got = watch_windows(spark, sf)
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
    for rows in ([("2025-03-01 10:59:00", "a"), ("2025-03-09 00:00:00", "a")], [("2025-03-01 10:00:00", "a"), (None, "b")]):
        spark.createDataFrame(rows, "ts string, event_type string").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    rows = cycles.windowed_counts(cycles.read_stream(spark, str(tmp_path / "e"))).collect()
    assert {(str(r.hour), r.event_type, r.n) for r in rows} == {("2025-03-01 10:00:00", "a", 2), ("2025-03-09 00:00:00", "a", 1), ("None", "b", 1)}
