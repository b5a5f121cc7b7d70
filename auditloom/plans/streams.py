"""Queries of the streaming operators, each run over its table as a stream to the end."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.streaming import cycles


def watch_cycles(spark: SparkSession, d: str) -> DataFrame:
    return cycles.record_cycles(cycles.read_stream(spark, f"{d}/events.parquet"))


def watch_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = cycles.read_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("subject"), F.col("event_type").alias("rule_id"))
    return cycles.first_alerts(rows)


def watch_windows(spark: SparkSession, d: str) -> DataFrame:
    return cycles.windowed_counts(cycles.read_stream(spark, f"{d}/events.parquet")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def watch_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = cycles.read_stream(spark, f"{d}/package_properties.parquet", 8).where("value_hash IS NOT NULL AND observed_at IS NOT NULL")
    return cycles.property_breaks(rows.withColumn("v", F.lower("value_hash"))).withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))


QUERIES = {"watch_cycles": watch_cycles, "watch_alerts": watch_alerts, "watch_windows": watch_windows, "watch_properties": watch_properties}

SQL = {
    "watch_cycles": "SELECT CAST(ts AS DATE) AS cycle, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL",
    "watch_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL",
    "watch_properties": """WITH o AS (
      SELECT package_name, property_key, observed_at, lower(value_hash) AS v, row_number() OVER w AS i, lag(lower(value_hash)) OVER w AS before FROM package_properties WHERE value_hash IS NOT NULL AND observed_at IS NOT NULL
      WINDOW w AS (PARTITION BY package_name, property_key ORDER BY observed_at, obs_id)),
    s AS (SELECT *, lag(i) OVER (PARTITION BY package_name, property_key ORDER BY i) AS prior FROM o WHERE before IS DISTINCT FROM v)
    SELECT package_name, property_key, observed_at, before AS old_value, v AS new_value, i - prior - 1 AS stable_for_n, round(least(1.0, 1 - 1 / (1 + pow(i - prior - 10, 0.7))), 6) AS weight FROM s WHERE i - prior > 10""",
    "watch_alerts": "SELECT DISTINCT user_id AS subject, event_type AS rule_id FROM events",
}
