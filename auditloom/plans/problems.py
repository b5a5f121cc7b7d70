"""The queries of the general data problems 2 to 5."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import name_key, version_key
from auditloom.operators import attribute_history, orphan_refs, schema_drift, snapshot_delta
from auditloom.sources import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of fields between consecutive files of a feed."""
    return schema_drift.field_changes(schema_drift.parsed_records(table(spark, d, "seed_records")))


def p2_union_schema(spark: SparkSession, d: str) -> DataFrame:
    """The union schema of each table over all files."""
    return schema_drift.union_schema(schema_drift.parsed_records(table(spark, d, "seed_records")))


def _unified(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return schema_drift.unified_table(table(spark, d, "seed_records"), name)

    return query


def _references(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, n).select(F.lit(n).alias("table_name"), F.col("id").alias("record_id"), F.col("first_seen_package_id").alias("ref_key"), F.col("imported_at").alias("at"))
        for n in ("source_urls", "maintainers")
    ]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose first_seen_package_id leads to no valid package."""
    return orphan_refs.orphan_records(_references(spark, d), table(spark, d, "packages"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphan_refs.orphan_counts(_references(spark, d), table(spark, d, "packages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each version of each property with its period."""
    return attribute_history.attribute_history(table(spark, d, "package_properties")).select("package_name", "property_key", "valid_from", "valid_to")


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """Each version of each property with its attributes and period."""
    return attribute_history.attribute_history(table(spark, d, "package_properties"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Packages added, removed or of another version between consecutive snapshots."""
    s = table(spark, d, "package_snapshots")
    return snapshot_delta.snapshot_changes(s, name_key(F.col("name")), {"current_version": version_key(F.col("current_version"))}).drop("changed_fields")


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """The same for version and maintainer, with the names of the changed fields."""
    s = table(spark, d, "package_snapshots")
    fields = {"current_maintainer": name_key(F.col("current_maintainer")), "current_version": version_key(F.col("current_version"))}
    changes = snapshot_delta.snapshot_changes(s, name_key(F.col("name")), fields)
    return changes.withColumn("changed_fields", F.array_join("changed_fields", ","))


QUERIES = {
    "p2_found": p2_found,
    "p2_union_schema": p2_union_schema,
    "p2_packages": _unified("packages"),
    "p2_maintainers_hashed": _unified("maintainers_hashed"),
    "p2_source_urls": _unified("source_urls"),
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_history": p4_history,
    "p5_found": p5_found,
    "p5_fields": p5_fields,
}

_WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

_P3 = """
WITH held AS (
  SELECT id, added_at, removed_at FROM packages
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_checked DESC NULLS LAST, added_at DESC NULLS LAST, removed_at DESC NULLS LAST) = 1),
refs AS (
  SELECT 'source_urls' AS table_name, id AS record_id, first_seen_package_id AS k, imported_at AS ts FROM source_urls
  UNION ALL SELECT 'maintainers', id, first_seen_package_id, imported_at FROM maintainers),
judged AS (
  SELECT table_name, record_id, ts,
         CASE WHEN held.id IS NULL THEN 'missing' WHEN removed_at IS NOT NULL THEN 'deleted' WHEN added_at > ts THEN 'late' END AS reason
  FROM refs LEFT JOIN held ON k = held.id WHERE k IS NOT NULL AND k <> 0)
"""

_P4 = r"""
WITH counted AS (
  SELECT *, trim(value) AS t FROM package_properties WHERE value IS NOT NULL AND observed_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY package_name, property_key, observed_at ORDER BY obs_id DESC) = 1),
canon AS (
  SELECT *, CASE WHEN t LIKE '[%' THEN list_sort(list_distinct(from_json(t, '["varchar"]')))::VARCHAR
                 WHEN lower(trim(t, '"')) IN ('true', 'false') THEN lower(trim(t, '"')) ELSE trim(trim(t, '"')) END AS v FROM counted),
starts AS (
  SELECT *, lag(v) OVER w IS DISTINCT FROM v AS starts FROM canon WINDOW w AS (PARTITION BY package_name, property_key ORDER BY observed_at)),
versions AS (
  SELECT *, CAST(floor(epoch(CASE WHEN regexp_matches(last_changed, '(Z|[+-]\d\d:\d\d)$') THEN last_changed::TIMESTAMPTZ
                                  ELSE (last_changed || 'Z')::TIMESTAMPTZ END)) AS BIGINT) AS valid_from FROM starts WHERE starts),
history AS (
  SELECT package_name, property_key, value, CAST(stable_for_n AS BIGINT) AS stable_for_n, first_seen, last_changed, valid_from,
         coalesce(lead(valid_from) OVER (PARTITION BY package_name, property_key ORDER BY observed_at), -1) AS valid_to FROM versions)
"""

_P5 = f"""
WITH held AS (
  SELECT snapshot_no, max(delivery_no) AS delivery_no FROM package_snapshots GROUP BY 1),
linked AS (SELECT *, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM held),
cells AS (
  SELECT DISTINCT snapshot_no, next_no, lower(trim(name, {_WS})) AS name,
         coalesce('=' || regexp_replace(trim(current_version, {_WS}), '^0:', ''), '') AS v,
         coalesce('=' || lower(trim(current_maintainer, {_WS})), '') AS m
  FROM package_snapshots JOIN linked USING (snapshot_no, delivery_no) WHERE name IS NOT NULL),
rows_ AS (
  SELECT snapshot_no, next_no, name, list_sort(list_distinct(list(v))) AS v, list_sort(list_distinct(list(m))) AS m FROM cells GROUP BY ALL),
pairs AS (
  SELECT coalesce(o.next_no, n.snapshot_no) AS snapshot_no, coalesce(o.name, n.name) AS name, o.name IS NULL AS fresh, n.name IS NULL AS gone,
         o.v IS DISTINCT FROM n.v AS dv, o.m IS DISTINCT FROM n.m AS dm
  FROM (SELECT * FROM rows_ WHERE next_no IS NOT NULL) o
  FULL JOIN (SELECT * FROM rows_ WHERE snapshot_no > (SELECT min(snapshot_no) FROM held)) n ON o.next_no = n.snapshot_no AND o.name = n.name)
"""

_P2 = """
WITH obj AS (
  SELECT feed, table_name, file_no, line_no, record_key, record_id, payload FROM seed_records
  WHERE payload IS NOT NULL AND json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload ELSE 'null' END) = 'OBJECT'),
cells AS (
  SELECT feed, table_name, file_no, line_no, record_key, record_id, k, json_extract(payload, '$."' || k || '"') AS v
  FROM (SELECT *, unnest(json_keys(payload)) AS k FROM obj)),
typed AS (
  SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'double'
                          WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS t FROM cells),
files AS (
  SELECT feed, table_name, file_no, count(*) AS n, lag(file_no) OVER (PARTITION BY feed, table_name ORDER BY file_no) AS prior_no FROM obj GROUP BY 1, 2, 3),
ranked AS (
  SELECT feed, table_name, file_no, k, t, count(*) AS n, CASE t WHEN 'boolean' THEN 0 WHEN 'integer' THEN 1 WHEN 'double' THEN 2 WHEN 'string' THEN 3 WHEN 'array' THEN 4 ELSE 5 END AS r
  FROM typed GROUP BY ALL),
owned AS (
  SELECT r.feed, r.table_name, r.file_no, r.k, max_by(t, (r.n, r.r)) FILTER (t IS NOT NULL) AS own
  FROM ranked r JOIN files f USING (feed, table_name, file_no) GROUP BY r.feed, r.table_name, r.file_no, r.k, f.n HAVING 2 * sum(r.n) >= f.n),
fields AS (
  SELECT feed, table_name, file_no, k, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY feed, table_name, k ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS t FROM owned),
sides AS (
  SELECT f.feed, f.table_name, f.file_no AS at_no, prior_no, k, t AS new_t, NULL AS old_t, true AS is_new FROM fields f JOIN files USING (feed, table_name, file_no) WHERE prior_no IS NOT NULL
  UNION ALL SELECT l.feed, l.table_name, l.file_no, l.prior_no, k, NULL, t, false FROM files l JOIN fields f ON f.feed = l.feed AND f.table_name = l.table_name AND f.file_no = l.prior_no),
both_ AS (SELECT feed, table_name, at_no, prior_no, k, max(new_t) AS new_t, max(old_t) AS old_t, bool_or(is_new) AS in_new, bool_or(NOT is_new) AS in_old FROM sides GROUP BY 1, 2, 3, 4, 5),
known AS (SELECT feed, table_name, file_no, record_key, k, max_by(CAST(v AS VARCHAR), line_no) AS v FROM typed WHERE record_key IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
pairs AS (
  SELECT g.feed, g.table_name, g.at_no, g.k AS gone, n.k AS fresh, count(*) AS n, count(*) FILTER (a.v = b.v) AS same
  FROM both_ g JOIN both_ n ON g.feed = n.feed AND g.table_name = n.table_name AND g.at_no = n.at_no AND g.in_old AND NOT g.in_new AND n.in_new AND NOT n.in_old
  JOIN known a ON a.feed = g.feed AND a.table_name = g.table_name AND a.file_no = g.prior_no AND a.k = g.k
  JOIN known b ON b.feed = g.feed AND b.table_name = g.table_name AND b.file_no = g.at_no AND b.k = n.k AND b.record_key = a.record_key
  GROUP BY 1, 2, 3, 4, 5 HAVING 2 * count(*) FILTER (a.v = b.v) > count(*)),
renamed AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY feed, table_name, at_no, gone ORDER BY same / n DESC, gone, fresh) = 1
    AND row_number() OVER (PARTITION BY feed, table_name, at_no, fresh ORDER BY same / n DESC, gone, fresh) = 1)
"""

SQL = {
    "p2_found": _P2
    + """SELECT feed, table_name, at_no AS file_no, 'renamed' AS change_kind, gone AS field_name, fresh AS new_name FROM renamed
UNION ALL SELECT feed, table_name, at_no, 'retyped', k, '' FROM both_ WHERE in_new AND in_old AND new_t <> old_t
UNION ALL SELECT feed, table_name, at_no, 'removed', k, '' FROM both_ b WHERE in_old AND NOT in_new AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = b.feed AND r.table_name = b.table_name AND r.at_no = b.at_no AND r.gone = b.k)
UNION ALL SELECT feed, table_name, at_no, 'added', k, '' FROM both_ b WHERE in_new AND NOT in_old AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = b.feed AND r.table_name = b.table_name AND r.at_no = b.at_no AND r.fresh = b.k)""",
    "p2_union_schema": _P2
    + """SELECT table_name, k AS field_name, CASE WHEN count(DISTINCT t) = 0 THEN 'string' WHEN count(DISTINCT t) = 1 THEN max(t) WHEN bool_and(t IN ('integer', 'double')) THEN 'double' ELSE 'string' END AS type,
      count(DISTINCT feed) AS n_feeds, count(*) AS n_files, min(file_no) AS first_file_no FROM fields GROUP BY 1, 2""",
    "p3_found": _P3 + "SELECT table_name, record_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_counts": _P3 + "SELECT table_name, CAST(date_trunc('month', ts) AS DATE) AS period, reason, count(*) AS n_refs FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT package_name, property_key, valid_from, valid_to FROM history",
    "p4_history": _P4 + "SELECT * FROM history",
    "p5_found": _P5 + "SELECT snapshot_no, name, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change_kind FROM pairs WHERE fresh OR gone OR dv",
    "p5_fields": _P5
    + """SELECT snapshot_no, name, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change_kind,
      CASE WHEN fresh OR gone THEN '' ELSE concat_ws(',', CASE WHEN dm THEN 'current_maintainer' END, CASE WHEN dv THEN 'current_version' END) END AS changed_fields
      FROM pairs WHERE fresh OR gone OR dv OR dm""",
}
