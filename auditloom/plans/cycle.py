"""Queries of the corpus cycle."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import sweep
from auditloom.operators.blocked import day_block, with_previous
from auditloom.plans import relational
from auditloom.sources import table

_CHANGES = relational._HELD + """, changes AS (
  SELECT coalesce(o.next_no, n.snapshot_no) AS snapshot_no, coalesce(o.name, n.name) AS name, coalesce(n.maintainer, '') AS maintainer,
         CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' WHEN o.version IS DISTINCT FROM n.version THEN 'modified' END AS status
  FROM (SELECT * FROM held WHERE next_no IS NOT NULL) o FULL JOIN (SELECT * FROM held WHERE snapshot_no > (SELECT min(snapshot_no) FROM held)) n ON o.next_no = n.snapshot_no AND o.name = n.name),
live AS (SELECT * FROM changes WHERE status IN ('added', 'modified')),
intro AS (SELECT snapshot_no, count(*) AS k FROM live WHERE status = 'added' GROUP BY 1),
act AS (SELECT maintainer, snapshot_no, count(*) AS k FROM live WHERE maintainer <> '' GROUP BY 1, 2),
dev AS (
  SELECT 'R125' AS rule_id, CAST(snapshot_no AS VARCHAR) AS subject, snapshot_no, k, count(k) OVER w AS c, avg(k) OVER w AS mean, stddev_samp(k) OVER w AS sd FROM intro WINDOW w AS (ORDER BY snapshot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT 'R108', maintainer, snapshot_no, k, count(k) OVER w, avg(k) OVER w, stddev_samp(k) OVER w FROM act WINDOW w AS (PARTITION BY maintainer ORDER BY snapshot_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """What was added, modified and removed between consecutive snapshots."""
    return sweep.cycle_changes(relational._held(spark, d))


def corpus_findings(spark: SparkSession, d: str) -> DataFrame:
    """All corpus detectors, with thresholds that these small snapshots can reach."""
    return sweep.corpus_findings(relational._held(spark, d), adoption=3, burst=3, far=0.5, near=1.0)


def property_rules(spark: SparkSession, d: str) -> DataFrame:
    return sweep.property_findings(relational.property_breaks(spark, d))


def temporal_flags(spark: SparkSession, d: str) -> DataFrame:
    """Per customer: is the newest order of the last 72 hours, the first one of the last 30 days, the newest more than a year after the one before."""
    orders = table(spark, d, "orders").where("o_orderdate IS NOT NULL").select("o_orderkey", "o_custkey", "o_orderdate")
    linked = with_previous(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], day_block("o_orderdate"), F.col("o_orderdate"), "p")
    last = F.max(F.struct("o_orderdate", "o_orderkey", F.col("p.v").alias("v"))).alias("m")
    rows = linked.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_at"), last).select("o_custkey", "first_at", F.col("m.o_orderdate").alias("last_at"), F.col("m.v").alias("previous_at"))
    return sweep.temporal(rows, F.lit("1998-08-01 00:00:00").cast("timestamp")).select("o_custkey", "very_recent", "brand_new", "revived")


QUERIES = {"snapshot_diff": snapshot_diff, "corpus_findings": corpus_findings, "property_rules": property_rules, "temporal_flags": temporal_flags}

SQL = {
    "snapshot_diff": _CHANGES + "SELECT snapshot_no, name, status, maintainer FROM changes WHERE status IS NOT NULL",
    "corpus_findings": _CHANGES
    + """SELECT snapshot_no, 'R090' AS rule_id, 'MEDIUM' AS severity, name AS subject, 1::BIGINT AS n FROM moves WHERE new_maintainer <> ''
    UNION ALL SELECT snapshot_no, 'R071', 'HIGH', name, 1 FROM moves m WHERE new_maintainer <> '' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.next_no = m.snapshot_no AND h.maintainer = m.new_maintainer)
    UNION ALL SELECT snapshot_no, 'R126', 'MEDIUM', new_maintainer, count(*) FROM moves WHERE new_maintainer <> '' AND old_version IS DISTINCT FROM new_version GROUP BY ALL
    UNION ALL SELECT snapshot_no, 'R092', 'HIGH', maintainer, count(*) FROM live WHERE status = 'added' AND maintainer <> '' GROUP BY ALL HAVING count(*) >= 3
    UNION ALL SELECT snapshot_no, 'R105', 'MEDIUM', maintainer, count(*) FROM live WHERE status = 'modified' AND maintainer <> '' GROUP BY ALL HAVING count(*) >= 3
    UNION ALL SELECT snapshot_no, rule_id, 'MEDIUM', subject, k FROM dev WHERE c >= 3 AND k >= 3
      AND round(CASE WHEN sd > 0 THEN (k - mean) / sd ELSE (k - mean) / greatest(mean, 1.0) END, 6) >= CASE rule_id WHEN 'R125' THEN 0.5 ELSE 1.0 END""",
    "property_rules": relational.SQL["property_breaks"].replace("SELECT package_name, property_key, observed_at, v0", "SELECT package_name, property_key, observed_at, "
    "CASE WHEN property_key IN ('license', 'install_hook_present') THEN 'R083' WHEN property_key = 'configure_flags' THEN 'R094' WHEN property_key = 'depends' THEN 'R095' WHEN property_key IN ('source_hosts', 'source_orgs') THEN 'R096' "
    "WHEN property_key = 'version_scheme' THEN 'R097' WHEN property_key = 'pkgdesc_tokens' THEN 'R098' ELSE 'R102' END AS rule_id, "
    "CASE WHEN property_key IN ('configure_flags', 'depends') THEN 'HIGH' WHEN property_key = 'version_scheme' THEN 'INFO' ELSE 'MEDIUM' END AS severity, v0"),
    "temporal_flags": """WITH r AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn,
      min(o_orderdate) OVER (PARTITION BY o_custkey) AS f FROM orders WHERE o_orderdate IS NOT NULL)
    SELECT o_custkey, epoch(TIMESTAMP '1998-08-01') - floor(epoch(o_orderdate)) < 72 * 3600 AS very_recent, epoch(TIMESTAMP '1998-08-01') - floor(epoch(f)) < 30 * 86400 AS brand_new,
      coalesce(floor(epoch(o_orderdate)) - floor(epoch(p)) > 365 * 86400, false) AS revived FROM r WHERE rn = 1""",
}
