"""Queries of dependencies, payloads, identities, dataflow, reports and feeds over the domain tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import payload, urls
from auditloom.functions.text import name_key
from auditloom.operators import dataflow, dependencies, diffs, reports, scoring
from auditloom.plans import audit, relational
from auditloom.sources import feeds, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


_ADDED = """WITH dep AS (SELECT DISTINCT package_name AS subject, unnest(from_json(value, '["varchar"]')) AS name, observed_at FROM package_properties WHERE property_key = 'depends' AND trim(value) LIKE '[%'),
added AS (SELECT DISTINCT subject, name FROM dep WHERE observed_at >= TIMESTAMP '2023-03-01'),
known AS (SELECT name, count(*) AS n FROM dep WHERE observed_at < TIMESTAMP '2023-03-01' GROUP BY 1)
"""


def _dependencies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Names that packages depend on from March 2023 on, and how often each was observed before."""
    rows = table(spark, d, "package_properties").where("property_key = 'depends' AND trim(value) LIKE '[%'")
    dep = rows.select(F.col("package_name").alias("subject"), F.explode(F.from_json("value", "array<string>")).alias("name"), "observed_at").distinct()
    cut = F.lit("2023-03-01").cast("timestamp_ntz")
    return dep.where(F.col("observed_at") >= cut).select("subject", "name").distinct(), dep.where(F.col("observed_at") < cut).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(_ADDED + "SELECT subject, name FROM added WHERE name NOT IN (SELECT name FROM known) AND EXISTS (SELECT 1 FROM known)")
def novel_dependency(spark: SparkSession, d: str, given: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    added, known = given or _dependencies(spark, d)
    return dependencies.novel(added, known).select("subject", "name")


@query(_ADDED + """SELECT subject, count(*) AS n_added, round(count(*) * avg(1 / (1 + coalesce(n, 0))), 6) AS magnitude FROM added LEFT JOIN known USING (name)
  GROUP BY 1 HAVING count(*) >= 3 AND round(count(*) * avg(1 / (1 + coalesce(n, 0))), 6) >= 0.05""")
def dependency_expansion(spark: SparkSession, d: str, given: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    return dependencies.expansion(*(given or _dependencies(spark, d)), gate=0.05)


@query(_ADDED + f""", given AS (SELECT DISTINCT name, 0 AS n, 10 AS ratio, {relational._STEM} AS stem FROM added WHERE name NOT IN (SELECT name FROM known) AND EXISTS (SELECT 1 FROM known)),
  popular AS (SELECT name, n, {relational._STEM} AS stem FROM known)""" + relational._NEAR)
def dependency_typosquat(spark: SparkSession, d: str, given: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """New dependency names that nothing knew, close to a known one."""
    added, known = given or _dependencies(spark, d)
    fresh = dependencies.novel(added, known).select("name").distinct().withColumn("n", F.lit(0).cast("long"))
    return dependencies.near_names(fresh, known, 10)


@query(r"""WITH e AS (SELECT DISTINCT name FROM packages WHERE removed_at IS NULL),
  p AS (SELECT DISTINCT package_name AS subject, unnest(from_json(value, '["varchar"]')) AS name FROM package_properties WHERE property_key = 'depends' AND trim(value) LIKE '[%'),
  s AS (SELECT subject, name, regexp_replace(subject, '^(.+?)(?:-git|-bin|-svn|-hg|-bzr|-nightly|-beta|-dev|-lts|-dkms|-static)+$', '\1') AS a, regexp_replace(name, '^(.+?)(?:-git|-bin|-svn|-hg|-bzr|-nightly|-beta|-dev|-lts|-dkms|-static)+$', '\1') AS b
    FROM (SELECT name AS subject, subject AS name FROM p) WHERE name IN (SELECT name FROM e))
  SELECT DISTINCT subject, name FROM s WHERE NOT (contains(a, b) OR contains(b, a))""")
def provides_hijack(spark: SparkSession, d: str) -> DataFrame:
    """Established packages among the users of a library, as if it provided their names."""
    rows = table(spark, d, "package_properties").where("property_key = 'depends' AND trim(value) LIKE '[%'")
    provided = rows.select(F.explode(F.from_json("value", "array<string>")).alias("subject"), F.col("package_name").alias("name")).distinct()
    return dependencies.hijacks(provided, table(spark, d, "packages").where("removed_at IS NULL"))


@query(r"""WITH p AS (SELECT DISTINCT id, name FROM packages), u AS (SELECT DISTINCT first_seen_package_id AS id, trim(url) AS url FROM source_urls WHERE url IS NOT NULL),
  w AS (SELECT name, url, list_filter(regexp_split_to_array(lower(regexp_replace(name, '-(?:git|bin|svn|hg|nightly|dkms|utils|data|cli)$', '')), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS a,
    list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(url, '^[^:]*://[^/]*/?', ''), '\.(?:git|tar|tgz|zip|gz|xz|zst|bz2)\b', '', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS b FROM p JOIN u USING (id))
  SELECT name, count(*) AS n_urls FROM w WHERE len(a) > 0 AND len(b) > 0 AND len(list_filter(a, lambda x: len(list_filter(b, lambda y: contains(y, x) OR contains(x, y))) > 0)) = 0 GROUP BY 1""")
def name_repo_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Packages by how many urls share no word with their name."""
    p = table(spark, d, "packages").select("id", "name").distinct()
    u = table(spark, d, "source_urls").where("url IS NOT NULL").select(F.col("first_seen_package_id").alias("id"), F.trim("url").alias("url")).distinct()
    return p.join(u, "id").where(dependencies.shares_no_token(F.col("name"), F.col("url"))).groupBy("name").agg(F.count(F.lit(1)).alias("n_urls"))


#: Hosts of the test tables taken as canonical for an ecosystem.
_CANONICAL = [("python", "fernpost.example"), ("perl", "cairnworks.example"), ("ttf", "millrace.example")]


@query(f"""WITH c(prefix, domain) AS (VALUES {", ".join(map(str, _CANONICAL))}),
  h AS (SELECT DISTINCT p.name, regexp_extract(p.name, '^([a-z]+)-', 1) AS prefix, {relational._HOST} AS host FROM packages p JOIN source_urls u ON u.first_seen_package_id = p.id)
  SELECT DISTINCT name, prefix FROM h WHERE prefix IN (SELECT prefix FROM c) AND name NOT IN (SELECT name FROM h JOIN c USING (prefix) WHERE host = domain OR ends_with(host, '.' || domain))""")
def name_host_divergence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "packages").select("id", "name").distinct()
    hosts = table(spark, d, "source_urls").select(F.col("first_seen_package_id").alias("id"), urls.host_of(F.trim("url")).alias("host")).join(p, "id").select("name", "host").distinct()
    return dependencies.outside_hosts(hosts, spark.createDataFrame(_CANONICAL, "prefix string, domain string"))


@query("""WITH h AS (SELECT DISTINCT package_name, unnest(from_json(value, '["varchar"]')) AS host FROM package_properties WHERE property_key = 'source_hosts' AND trim(value) LIKE '[%'),
  o AS (SELECT DISTINCT package_name, regexp_extract(unnest(from_json(value, '["varchar"]')), '^[^/]+') AS host FROM package_properties WHERE property_key = 'source_orgs' AND trim(value) LIKE '[%')
  SELECT package_name, host FROM h EXCEPT SELECT package_name, host FROM o""")
def metadata_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Hosts that a package's list of hosts names and its list of owners doesn't."""
    rows = table(spark, d, "package_properties").where("trim(value) LIKE '[%'")
    items = lambda k: rows.where(F.col("property_key") == k).select("package_name", F.explode(F.from_json("value", "array<string>")).alias("host"))
    owners = items("source_orgs").withColumn("host", F.substring_index("host", "/", 1))
    return dependencies.undeclared_hosts(items("source_hosts"), owners, "package_name")


@query()
def payload_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines with an encoded executable: doc_id, idx, payload."""
    lines = audit.text_lines(spark, d).where(F.length("body") >= 24)
    return lines.select("doc_id", "idx", payload.payload_of("body").alias("payload")).where("payload IS NOT NULL")


_MIXED = r"""len(list_filter(string_split(host, '.'), lambda x: regexp_matches(x, '\p{Latin}') AND regexp_matches(x, '[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}]') OR regexp_matches(x, '^[аеорсухіјѕԁһ0-9-]*[аеорсухіјѕԁһ][аеорсухіјѕԁһ0-9-]*$'))) > 0"""


@query(f"SELECT DISTINCT host, {_MIXED} AS mixed FROM (SELECT {relational._HOST} AS host FROM source_urls)")
def homograph_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Each host of the source urls, and whether it passes for another."""
    hosts = table(spark, d, "source_urls").select(urls.host_of(F.trim("url")).alias("host")).distinct()
    return hosts.withColumn("mixed", payload.homograph("host"))


@query(r"SELECT doc_id, regexp_matches(text, '[\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}]') OR regexp_matches(text, '(^|[\x00-\x7F])[\x{200B}-\x{200F}\x{FEFF}]([\x00-\x7F]|$)') AS fatal FROM documents WHERE text IS NOT NULL")
def fatal_codepoints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", payload.has_fatal_codepoints(F.col("text")).alias("fatal"))


@query(f"SELECT DISTINCT sha256('pepper|' || lower(trim(name, {relational._WS}))) AS name_hash FROM maintainers WHERE name IS NOT NULL")
def identity_hash(spark: SparkSession, d: str) -> DataFrame:
    """Maintainers as salted identities."""
    own = table(spark, d, "maintainers").where("name IS NOT NULL").select("name").distinct().select(payload.identity_key("name").alias("k"))
    return own.select(payload.salted_hash(F.col("k"), "pepper").alias("name_hash")).distinct()


@query("""SELECT url, min_by(first_seen_package_id, id) FILTER (first_seen_package_id IS NOT NULL OR true) AS first_seen_package_id, arg_min_null(first_seen_globally_timestamp, id) AS first_seen_globally_timestamp,
  CAST(sum(total_uses) AS BIGINT) AS total_uses, max(last_seen_timestamp) AS last_seen_timestamp FROM source_urls WHERE url IS NOT NULL GROUP BY 1""".replace("min_by(first_seen_package_id, id) FILTER (first_seen_package_id IS NOT NULL OR true)", "arg_min_null(first_seen_package_id, id)"))
def seed_url_merge(spark: SparkSession, d: str) -> DataFrame:
    return feeds.merge_urls(table(spark, d, "source_urls"))


@query()
def flow_findings(spark: SparkSession, d: str) -> DataFrame:
    return dataflow.flow_findings(dataflow.diff_actions(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query()
def recipe_diffs(spark: SparkSession, d: str) -> DataFrame:
    """The unified diff between each document and the one posted before it about the same package."""
    from auditloom.operators.blocked import day_block, with_previous

    rows = table(spark, d, "documents").where("text IS NOT NULL AND package_name IS NOT NULL AND posted_at IS NOT NULL").select("doc_id", "package_name", "posted_at", "text")
    both = with_previous(rows, ["package_name"], ["posted_at", "doc_id"], day_block("posted_at"), F.col("text"), "before").where("before IS NOT NULL")
    return both.select("doc_id", reports.unified_diff("before.v", "text").alias("diff"))


@query()
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary(diffs.diff_facts(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(audit._FINDINGS + """SELECT doc_id, array_to_string(list(severity || ' ' || rule_id ORDER BY r DESC, rule_id)[1:5], '; ') || CASE WHEN count(*) > 5 THEN ' and ' || (count(*) - 5) || ' more' ELSE '' END AS verdict FROM weighed GROUP BY 1""")
def verdict(spark: SparkSession, d: str) -> DataFrame:
    return reports.verdicts(audit._findings(spark, d), "doc_id")


@query(audit._FINDINGS + "SELECT doc_id, score, n_findings, worst FROM scores WHERE score > 20")
def review_threshold(spark: SparkSession, d: str) -> DataFrame:
    return reports.over_threshold(scoring.scores(audit._findings(spark, d), "doc_id"))


@query(audit._FINDINGS + """SELECT doc_id, '{"doc_id":' || doc_id || ',"score":' || score || ',"n_findings":' || n_findings || ',"worst":"' || worst || '"}' AS report FROM scores""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    return reports.body(scoring.scores(audit._findings(spark, d), "doc_id"), "doc_id")


@query(f"""SELECT DISTINCT name FROM (SELECT lower(trim(name, {relational._WS})) AS name FROM package_snapshots) WHERE name IS NOT NULL AND NOT starts_with(name, '__')
  AND name NOT IN (SELECT name FROM packages WHERE removed_at IS NULL)""")
def prune(spark: SparkSession, d: str) -> DataFrame:
    """Names of snapshots that the registry no longer holds."""
    tracked = table(spark, d, "package_snapshots").select(name_key(F.col("name")).alias("name")).where("name IS NOT NULL")
    return reports.untracked(tracked, table(spark, d, "packages").where("removed_at IS NULL"))


@query("SELECT * FROM maintainers WHERE name NOT IN (SELECT current_maintainer FROM packages WHERE current_maintainer IS NOT NULL AND aur_orphaned = 1)")
def forget(spark: SparkSession, d: str) -> DataFrame:
    """The maintainers' rows without those whose packages were orphaned."""
    gone = table(spark, d, "packages").where("aur_orphaned = 1").select(F.col("current_maintainer").alias("name"))
    m = table(spark, d, "maintainers")
    return reports.without(m.where("name IS NOT NULL"), "name", gone).select(*m.columns)


@query("""SELECT (SELECT count(DISTINCT id) FROM packages) AS n_packages, (SELECT count(*) FROM source_urls) AS n_url_rows, (SELECT count(DISTINCT name_hash) FROM maintainers_hashed) AS n_hashes,
  (SELECT count(*) FROM packages WHERE removed_at IS NOT NULL) AS n_removed""")
def status(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the store, one row; each table is read once."""
    p = table(spark, d, "packages").agg(F.count_distinct("id").alias("n_packages"), F.count("removed_at").alias("n_removed"))
    u = table(spark, d, "source_urls").agg(F.count(F.lit(1)).alias("n_url_rows"))
    h = table(spark, d, "maintainers_hashed").agg(F.count_distinct("name_hash").alias("n_hashes"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(p).join(one(u), "k").join(one(h), "k").select("n_packages", "n_url_rows", "n_hashes", "n_removed")


@query(r"SELECT doc_id, CAST(sum(CASE WHEN starts_with(body, '+') THEN 1 ELSE 0 END) AS BIGINT) AS n_added, CAST(sum(CASE WHEN starts_with(body, '-') THEN 1 ELSE 0 END) AS BIGINT) AS n_removed FROM (" + audit._LINES.strip().replace("WITH t AS", "WITH t AS", 1) + " SELECT * FROM lines) GROUP BY 1")
def diff_line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines that begin with + and with -, headers among them."""
    first = lambda s: F.count_if(F.col("body").startswith(s))
    return audit.text_lines(spark, d).groupBy("doc_id").agg(first("+").alias("n_added"), first("-").alias("n_removed"))


@query("""SELECT package_name, property_key, count(*) AS n, round(least(1.0, count(*) / 50.0), 6) AS maturity FROM package_properties GROUP BY ALL""")
def maturity(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "package_properties").groupBy("package_name", "property_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("maturity", F.round(scoring.maturity(F.col("n")), 6))
