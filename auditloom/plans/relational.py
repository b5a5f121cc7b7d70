"""Queries of the relational operators: snapshots, groups, sequences, graphs, indicators, scoring."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import names, urls
from auditloom.functions.text import name_key
from auditloom.operators import corpus, dependencies, graph, indicators, scoring
from auditloom.operators.blocked import day_block
from auditloom.sources import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that says the same."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


_WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

# ---- snapshots -------------------------------------------------------------------------------------------------------

_HELD = f"""
WITH d AS (SELECT snapshot_no, max(delivery_no) AS delivery_no FROM package_snapshots GROUP BY 1),
l AS (SELECT *, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS next_no FROM d),
rows_ AS (
  SELECT snapshot_no, next_no, lower(trim(name, {_WS})) AS name, trim(current_version) AS version, coalesce(lower(trim(current_maintainer, {_WS})), '') AS maintainer
  FROM package_snapshots JOIN l USING (snapshot_no, delivery_no) WHERE name IS NOT NULL),
held AS (
  SELECT snapshot_no, next_no, name, version, maintainer FROM rows_
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, name ORDER BY version DESC NULLS LAST, maintainer DESC) = 1),
moves AS (
  SELECT n.snapshot_no, n.name, o.maintainer AS old_maintainer, o.version AS old_version, n.maintainer AS new_maintainer, n.version AS new_version,
         CASE WHEN n.maintainer = '' THEN 'orphaned' WHEN o.maintainer = '' THEN 'adopted' ELSE 'transferred' END AS kind
  FROM held o JOIN held n ON o.next_no = n.snapshot_no AND o.name = n.name WHERE o.maintainer <> n.maintainer)
"""


def _held(spark: SparkSession, d: str) -> DataFrame:
    return corpus.held_snapshots(table(spark, d, "package_snapshots"))


@query(_HELD + "SELECT * FROM moves")
def ownership_transitions(spark: SparkSession, d: str) -> DataFrame:
    return corpus.transitions(_held(spark, d))


@query(_HELD + """SELECT * FROM moves m WHERE new_maintainer <> '' AND NOT EXISTS (
  SELECT 1 FROM held h WHERE h.next_no = m.snapshot_no AND h.maintainer = m.new_maintainer)""")
def untrusted_takeover(spark: SparkSession, d: str) -> DataFrame:
    return corpus.takeovers(_held(spark, d))


@query(_HELD + """SELECT snapshot_no, new_maintainer, count(*) AS n_packages, min(name) AS first_name FROM moves
  WHERE new_maintainer <> '' AND old_version IS DISTINCT FROM new_version GROUP BY ALL""")
def adopt_then_modify(spark: SparkSession, d: str) -> DataFrame:
    return corpus.adopt_then_modify(_held(spark, d))


_HOLDS = """
WITH held AS (SELECT * FROM packages QUALIFY row_number() OVER (
  PARTITION BY id ORDER BY last_checked DESC NULLS LAST, added_at DESC NULLS LAST, removed_at DESC NULLS LAST, name DESC, current_version DESC NULLS LAST, current_maintainer DESC NULLS LAST, aur_orphaned DESC NULLS LAST) = 1)
"""


def _packages(spark: SparkSession, d: str) -> DataFrame:
    order = ["last_checked", "added_at", "removed_at", "name", "current_version", "current_maintainer", "aur_orphaned"]
    return corpus.latest(table(spark, d, "packages"), ["id"], order)


@query(_HOLDS + "SELECT * FROM held")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Each package's row that holds."""
    return _packages(spark, d)


@query(_HOLDS + f"""SELECT m AS maintainer, count(*) AS n, min(added_at) AS first_at, max(added_at) AS last_at
  FROM (SELECT lower(trim(current_maintainer, {_WS})) AS m, added_at FROM held) WHERE m <> '' AND added_at IS NOT NULL
  GROUP BY ALL HAVING count(*) >= 2 AND max(added_at) <= min(added_at) + INTERVAL 60 DAY""")
def mass_adoption(spark: SparkSession, d: str) -> DataFrame:
    """Maintainers whose packages all came within 60 days, two or more."""
    rows = _packages(spark, d).select(name_key(F.col("current_maintainer")).alias("maintainer"), "added_at")
    return corpus.span_groups(rows, "maintainer", "added_at", 2, "60 DAYS")


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE event_type = 'purchase' AND value > 60 AND user_id IS NOT NULL AND ts IS NOT NULL
  GROUP BY ALL HAVING count(*) >= 2 AND max(ts) <= min(ts) + INTERVAL 240 HOUR""")
def attribute_burst(spark: SparkSession, d: str) -> DataFrame:
    return corpus.span_groups(table(spark, d, "events").where("event_type = 'purchase' AND value > 60"), "user_id", "ts", 2, "240 HOURS")


@query("""WITH r AS (SELECT regexp_extract(url, '://([^/?#]*/[^/?#]+)', 1) AS repo, first_seen_package_id AS p FROM source_urls WHERE first_seen_package_id > 0)
  SELECT repo, count(DISTINCT p) AS n_members, count(DISTINCT p // 10) AS n_bases FROM r WHERE repo <> '' GROUP BY ALL HAVING count(DISTINCT p) >= 3 AND count(DISTINCT p // 10) >= 3""")
def shared_key_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Repositories that three or more packages of as many bases draw on."""
    rows = table(spark, d, "source_urls").where("first_seen_package_id > 0")
    rows = rows.select(F.nullif(F.regexp_extract("url", "://([^/?#]*/[^/?#]+)", 1), F.lit("")).alias("repo"), F.col("first_seen_package_id").alias("p"))
    return corpus.shared_keys(rows.withColumn("base", F.floor(F.col("p") / 10)), "repo", "p", "base", 3)


_DEVIATION = """round(CASE WHEN sd > 0 THEN (n - mean) / sd ELSE (n - mean) / greatest(mean, 1.0) END, 6) AS deviation"""


@query(f"""WITH c AS (SELECT CAST(date_trunc('month', added_at) AS DATE) AS period, count(DISTINCT id) AS n FROM packages WHERE added_at IS NOT NULL GROUP BY 1),
  h AS (SELECT *, count(n) OVER w AS n_before, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd FROM c WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT period, n, n_before, {_DEVIATION} FROM h WHERE n_before >= 3""")
def introduction_deviation(spark: SparkSession, d: str) -> DataFrame:
    """New packages per month against all months before."""
    counts = table(spark, d, "packages").where("added_at IS NOT NULL").groupBy(F.trunc("added_at", "month").alias("period")).agg(F.count_distinct("id").alias("n"))
    return corpus.period_deviation(counts, [], "period", "n")


@query(f"""WITH c AS (SELECT user_id, CAST(ts AS DATE) AS period, count(*) AS n FROM events GROUP BY ALL),
  h AS (SELECT *, count(n) OVER w AS n_before, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd FROM c WINDOW w AS (PARTITION BY user_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT user_id, period, n, n_before, {_DEVIATION} FROM h WHERE n_before >= 3""")
def maintainer_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Per user and day against the user's own days before."""
    counts = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return corpus.period_deviation(counts, ["user_id"], "period", "n")


@query("SELECT CAST(ts AS DATE) AS cycle, count(*) FILTER (event_type = 'signup') AS n_added, count(*) FILTER (event_type = 'error') AS n_removed, count(*) AS n_events FROM events GROUP BY ALL")
def cycle_history(spark: SparkSession, d: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("cycle")).agg(kind("signup").alias("n_added"), kind("error").alias("n_removed"), F.count(F.lit(1)).alias("n_events"))


@query("SELECT user_id, CAST(ts AS DATE) AS cycle, count(*) AS n FROM events GROUP BY ALL")
def activity_history(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("cycle")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id AS subject, event_type AS rule_id, min(ts) AS first_sent, max(ts) AS last_sent, count(*) AS times FROM events GROUP BY ALL")
def alert_dedup(spark: SparkSession, d: str) -> DataFrame:
    return corpus.alerts(table(spark, d, "events").select(F.col("user_id").alias("subject"), F.col("event_type").alias("rule_id"), "ts"), "ts")


@query("""SELECT name_hash, max_by(email_hash, row_id) FILTER (email_hash IS NOT NULL) AS email_hash, min(first_seen) AS first_seen, CAST(sum(package_count) AS BIGINT) AS package_count,
  coalesce(len(list_distinct(flatten(list(packages) FILTER (packages IS NOT NULL)))), 0) AS n_packages
  FROM (SELECT * REPLACE (regexp_replace(lower(trim(name_hash, """ + _WS + """)), '^sha256:', '') AS name_hash) FROM maintainers_hashed) WHERE name_hash <> '' GROUP BY 1""")
def seed_merge(spark: SparkSession, d: str) -> DataFrame:
    from auditloom.functions.text import hash_key

    rows = table(spark, d, "maintainers_hashed").withColumn("name_hash", hash_key(F.col("name_hash")))
    return corpus.seed_merge(rows.where("name_hash <> ''"))


# ---- sequences -------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_at FROM orders WHERE o_orderdate IS NOT NULL)
  SELECT *, CAST(floor((epoch(o_orderdate) - epoch(previous_at)) / 86400) AS BIGINT) AS gap_days FROM r WHERE floor(epoch(o_orderdate)) - floor(epoch(previous_at)) > 365 * 86400""")
def stale_revival(spark: SparkSession, d: str) -> DataFrame:
    return corpus.gaps(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey", 365)


@query("""WITH r AS (SELECT event_id, user_id, ts, lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM events WHERE ts IS NOT NULL)
  SELECT * FROM r WHERE since >= ts - INTERVAL 24 HOUR""")
def commit_burst(spark: SparkSession, d: str) -> DataFrame:
    """Events that are the third or later of their user within 24 hours."""
    return corpus.bursts(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 3)


@query("""WITH p AS (SELECT package_name, property_key, observed_at, value_hash AS v FROM package_properties WHERE value_hash IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY package_name, property_key, observed_at ORDER BY obs_id DESC) = 1),
  n AS (SELECT *, row_number() OVER w - 1 AS i, lag(v) OVER w AS before, row_number() OVER w = 1 OR lag(v) OVER w <> v AS chg FROM p WINDOW w AS (PARTITION BY package_name, property_key ORDER BY observed_at)),
  c AS (SELECT *, lag(i) OVER w AS i0, lag(v) OVER w AS v0 FROM n WHERE chg WINDOW w AS (PARTITION BY package_name, property_key ORDER BY observed_at))
  SELECT package_name, property_key, observed_at, v0 AS old_value, v AS new_value, i - i0 - 1 AS stable_for_n, round(least(1.0, 1 - 1 / (1 + pow(i - i0 - 1 - 10 + 1, 0.7))), 6) AS weight
  FROM c WHERE i0 IS NOT NULL AND i - i0 - 1 >= 10""")
def property_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Properties that change after ten or more observations without a change, by the stored hashes."""
    rows = table(spark, d, "package_properties").where("value_hash IS NOT NULL")
    rows = rows.groupBy("package_name", "property_key", "observed_at").agg(F.max_by("value_hash", "obs_id").alias("v"))
    return corpus.property_breaks(rows, ["package_name", "property_key"], ["observed_at"], day_block("observed_at"), "v", 10)


@query(r"""WITH u AS (SELECT id, first_seen_package_id AS p, regexp_replace(regexp_replace(lower(url), '\d+(\.\d+)+', '0', 'g'), '/+$', '') AS k FROM source_urls)
  SELECT id, p, k, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY id) = 1 AS first_global, k IS NOT NULL AND row_number() OVER (PARTITION BY p, k ORDER BY id) = 1 AS first_in_group FROM u""")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """First row of each url template, everywhere and within its package."""
    k = F.rtrim(F.regexp_replace(F.lower("url"), r"\d+(\.\d+)+", "0"), F.lit("/"))
    rows = table(spark, d, "source_urls").select("id", F.col("first_seen_package_id").alias("p"), k.alias("k"))
    return corpus.first_occurrences(rows, "k", "p", ["id"])


@query("""SELECT o_orderkey, o_custkey, o_orderdate, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3""")
def history_top_n(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's three newest orders."""
    return corpus.newest(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3)


@query("""SELECT lower(w) AS name, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, name LIMIT 5000""")
def top_names(spark: SparkSession, d: str) -> DataFrame:
    """The 5000 most frequent words of part names."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w"))
    return words.groupBy(F.lower("w").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(5000)


# ---- graph -----------------------------------------------------------------------------------------------------------

_EDGES = """
WITH RECURSIVE given AS (
  SELECT package_name AS src, unnest(from_json(value, '["varchar"]')) AS dst FROM package_properties WHERE property_key IN ('depends', 'source_orgs') AND trim(value) LIKE '[%'),
edges AS (SELECT DISTINCT src, dst FROM given WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst
  UNION SELECT DISTINCT dst, src FROM given WHERE dst NOT LIKE '%/%' AND src IS NOT NULL AND length(src) % 2 = 0)
"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Packages to what they depend on and draw from; libraries also back to some of their users, so that paths are longer than one hop."""
    rows = table(spark, d, "package_properties").where(F.col("property_key").isin("depends", "source_orgs"))
    forward = graph.edges_of(rows.select("package_name", F.from_json("value", "array<string>").alias("t")), "package_name", "t")
    back = forward.where(~F.col("dst").contains("/") & (F.length("src") % 2 == 0)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward.unionByName(back).distinct()


@query(_EDGES + "SELECT src, dst FROM edges")
def dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(_EDGES + "SELECT dst, count(*) AS n FROM edges GROUP BY 1 HAVING count(*) >= 5")
def in_degree(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    return graph.in_degree(edges or _edges(spark, d), 5)


_CLOSURE = _EDGES + """, paths AS (
  SELECT src, dst, 1 AS distance FROM edges
  UNION SELECT p.src, e.dst, distance + 1 FROM paths p JOIN edges e ON p.dst = e.src WHERE distance < 3 AND e.dst <> p.src),
closed AS (SELECT src, dst, min(distance) AS distance FROM paths GROUP BY 1, 2),
orphans AS (SELECT DISTINCT name FROM packages WHERE coalesce(trim(current_maintainer), '') = '')
"""


@query(_CLOSURE + "SELECT src, dst, distance FROM closed")
def closure_3hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_edges(spark, d), 3)


@query(_CLOSURE + "SELECT src, min_by(dst, (distance, dst)) AS via, min(distance) AS distance FROM closed JOIN orphans ON dst = name WHERE distance >= 2 GROUP BY 1")
def orphan_exposure(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    """Packages that reach one without a maintainer over two or three hops."""
    orphans = table(spark, d, "packages").where(F.coalesce(F.trim("current_maintainer"), F.lit("")) == "").select(F.col("name").alias("node")).distinct()
    return graph.exposure(edges or _edges(spark, d), orphans, 3)


@query(_EDGES + """, levels AS (
  SELECT name AS node, 0 AS level FROM (SELECT DISTINCT name FROM packages WHERE name LIKE 'python-%')
  UNION SELECT e.dst, level + 1 FROM levels JOIN edges e ON node = e.src WHERE level < 4)
, least AS (SELECT node, min(level) AS level FROM levels GROUP BY 1)
SELECT n.node, n.level, min(e.src) AS parent FROM least n LEFT JOIN (SELECT e.src, e.dst, l.level FROM edges e JOIN least l ON e.src = l.node) e ON e.dst = n.node AND e.level = n.level - 1 GROUP BY 1, 2""")
def dependency_walk(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "packages").where("name LIKE 'python-%'").select(F.col("name").alias("node"))
    return graph.walk(_edges(spark, d), roots, 4)


@query(_EDGES + f""", {_HELD.replace('WITH d AS', 'd AS', 1).strip()}
SELECT DISTINCT e.src, e.dst, m.kind, m.snapshot_no FROM edges e JOIN moves m ON e.dst = m.name WHERE m.kind <> 'transferred'""")
def orphan_dependency(spark: SparkSession, d: str, edges: DataFrame | None = None) -> DataFrame:
    """Packages that depend directly on one orphaned or adopted between two snapshots."""
    moves = corpus.transitions(_held(spark, d)).where("kind <> 'transferred'").select(F.col("name").alias("dst"), "kind", "snapshot_no")
    return (edges or _edges(spark, d)).join(moves, "dst").select("src", "dst", "kind", "snapshot_no").distinct()


# ---- urls and names --------------------------------------------------------------------------------------------------

#: Hosts of the test tables by what they are.
_DOMAINS = [("fernpost.example", "trusted_forge"), ("cairnworks.example", "trusted_forge"), ("git.brackenforge.example", "raw_hosting"), ("quernstone.example", "official"), ("dl.fernpost.example", "raw_hosting")]
_HOST = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^.*@', ''), ':(80|443)?$', ''), '\.+$', '')"""


@query(f"SELECT id, {_HOST} AS host, len(string_split({_HOST}, '.')) AS n_labels FROM source_urls")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    host = urls.host_of(F.trim("url"))
    return table(spark, d, "source_urls").select("id", host.alias("host"), F.size(F.split(host, r"\.")).cast("long").alias("n_labels"))


@query(f"""WITH h AS (SELECT id, {_HOST} AS host FROM source_urls),
  dom(domain, kind) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _DOMAINS)}),
  r AS (SELECT id, host, min(CASE WHEN kind = 'raw_hosting' AND host = domain THEN 0 WHEN kind = 'trusted_forge' THEN 1 WHEN kind = 'official' THEN 2 END) AS r
    FROM h LEFT JOIN dom ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1, 2)
  SELECT id, host, CASE r WHEN 0 THEN 'raw_hosting' WHEN 1 THEN 'trusted_forge' WHEN 2 THEN 'official' ELSE 'unknown' END AS bucket FROM r""")
def url_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_urls").select("id", urls.host_of(F.trim("url")).alias("host"))
    return urls.bucketed(rows, "host", spark.createDataFrame(_DOMAINS, "domain string, kind string"))


@query(r"""SELECT id, rtrim(regexp_replace(regexp_replace(regexp_replace(url, '(?i)\bv?\d+(?:\.\d+)+\b', '0', 'g'), '(?i)\b[0-9a-f]{32,}\b', 'HASH', 'g'), '\b(?:19|20)\d{2}-?\d{2}-?\d{2}\b', 'DATE', 'g'), '/') AS template FROM source_urls""")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_urls").select("id", urls.template(F.col("url")).alias("template"))


@query(r"""SELECT CASE WHEN total_uses > 4 THEN 'checksum_pinned' WHEN regexp_matches(url, '(?i)/branches?/|/heads/|/master[./"]|/main[./"]|/develop[./"]') THEN 'branch_pinned'
  WHEN regexp_matches(url, '(?i)/releases?/|/tags?/|/download/') OR regexp_matches(url, '(?:^|/)(?:v\d+(?:\.\d+)*|\d+(?:\.\d+)+)(?:/|$|\.)') THEN 'tag_pinned' ELSE 'unpinned' END AS level, count(*) AS n FROM source_urls GROUP BY 1""")
def pinning_level(spark: SparkSession, d: str) -> DataFrame:
    level = urls.pinning_level(F.col("url"), F.coalesce(F.col("total_uses") > 4, F.lit(False)))
    return table(spark, d, "source_urls").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH v AS (SELECT DISTINCT regexp_replace(regexp_replace(trim(current_version), '^\d+:', ''), '-[^-]*$', '') AS version FROM packages)
  SELECT version, CASE WHEN regexp_matches(version, '^[a-f][a-f0-9]{6,39}$') THEN 'hash' WHEN regexp_matches(version, '^\d{4}\.\d{1,2}(\.\d+)?$') THEN 'calver' WHEN regexp_matches(version, '^\d{8}$') THEN 'date'
    WHEN regexp_matches(version, '^\d+\.\d+\.\d+') THEN 'semver' ELSE 'other' END AS scheme FROM v""")
def version_scheme(spark: SparkSession, d: str) -> DataFrame:
    v = names.version_parts(F.trim("current_version"))["pkgver"]
    return table(spark, d, "packages").select(v.alias("version")).distinct().withColumn("scheme", names.version_scheme(F.col("version")))


@query("""SELECT CASE WHEN n IS NULL THEN 'unknown' WHEN n <= 5 THEN '0-5' WHEN n <= 15 THEN '6-15' WHEN n <= 40 THEN '16-40' WHEN n <= 100 THEN '41-100' WHEN n <= 300 THEN '101-300' WHEN n <= 1000 THEN '301-1000' ELSE '1001+' END AS bucket, count(*) AS n
  FROM (SELECT len(string_split(text, chr(10))) AS n FROM documents) GROUP BY 1""")
def line_bucket(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n")))
    return table(spark, d, "documents").groupBy(names.line_bucket(n).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z][a-z0-9_-]*'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in names.STOPWORDS)})))), ' ') AS tokens FROM part""")
def desc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(names.description_tokens(F.col("p_name")), " ").alias("tokens"))


@query(r"""SELECT DISTINCT name, regexp_replace(name, '^(.+?)(?:-git|-bin|-svn|-hg|-bzr|-nightly|-beta|-dev|-lts|-dkms|-static)+$', '\1') AS stem FROM packages""")
def name_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packages").select("name", names.stem(F.col("name")).alias("stem")).distinct()


_NEAR = """, pairs AS (
  SELECT g.name, p.name AS target, p.n AS target_n, damerau_levenshtein(g.name, p.name) AS distance FROM given g JOIN popular p
    ON p.n >= ratio * g.n AND g.stem <> p.stem AND abs(length(g.name) - length(p.name)) <= 2 AND length(g.name) >= 4
  WHERE damerau_levenshtein(g.name, p.name) BETWEEN 1 AND CASE WHEN length(g.name) < 8 THEN 1 ELSE 2 END)
SELECT name, target, CAST(distance AS INTEGER) AS distance FROM pairs QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, target_n DESC, target) = 1"""
_STEM = r"regexp_replace(name, '^(.+?)(?:-git|-bin|-svn|-hg|-bzr|-nightly|-beta|-dev|-lts|-dkms|-static)+$', '\1')"


@query(f"""WITH seen AS (SELECT lower(trim(name, {_WS})) AS name, count(*) AS n, 2 AS ratio FROM package_snapshots WHERE name IS NOT NULL GROUP BY 1),
  given AS (SELECT *, {_STEM} AS stem FROM seen), popular AS (SELECT name, n, stem FROM given)""" + _NEAR)
def typosquat(spark: SparkSession, d: str) -> DataFrame:
    """Package names one or two edits from another name that is seen twice as often: name, target, distance."""
    seen = table(spark, d, "package_snapshots").where("name IS NOT NULL").groupBy(name_key(F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return dependencies.near_names(seen, seen, 2)


#: A part of a version as a list that sorts as versions do: letters before the end, the end before numbers, numbers by value.
_RANK = """list_append(list_transform(regexp_extract_all({0}, '[0-9]+|[A-Za-z]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '2' || lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 9, '0') || ltrim(x, '0') ELSE '0' || x END), '1')"""


def _ranks(v: str) -> str:
    rest = rf"regexp_replace({v}, '^\d+:', '')"
    epoch = rf"CASE WHEN regexp_matches({v}, '^\d+:') THEN split_part({v}, ':', 1) ELSE '0' END"
    return ", ".join(f"{_RANK.format(part)} AS {name}" for part, name in ((epoch, "e"), (f"regexp_replace({rest}, '-[^-]*$', '')", "p"), (f"regexp_extract({rest}, '-([^-]*)$', 1)", "r"))) + rf", regexp_matches({rest}, '-[^-]+$') AS has_r"


@query(_HELD + f""", log AS (
    SELECT lower(trim(name, {_WS})) AS name, trim(current_version) AS latest FROM packages WHERE id > 0 AND removed_at IS NULL AND name IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY lower(trim(name, {_WS})) ORDER BY last_checked DESC NULLS LAST, added_at DESC NULLS LAST, id DESC, trim(current_version) DESC NULLS LAST) = 1),
  both_ AS (SELECT name, version, latest FROM held JOIN log USING (name) WHERE next_no IS NULL AND version IS NOT NULL AND latest IS NOT NULL),
  a AS (SELECT name, version, latest, {_ranks("version")} FROM both_), b AS (SELECT name, {_ranks("latest")} FROM both_)
  SELECT name, version, latest FROM a JOIN b USING (name) WHERE a.e < b.e OR a.e = b.e AND (a.p < b.p OR a.p = b.p AND a.has_r AND b.has_r AND a.r < b.r)""")
def outdated(spark: SparkSession, d: str) -> DataFrame:
    """Packages whose version in the newest snapshot is before that of the log's row that holds: of all rows of the name the one checked last."""
    held = _held(spark, d).where("next_no IS NULL").select("name", "version")
    log = _packages(spark, d).where("removed_at IS NULL AND name IS NOT NULL").select(name_key(F.col("name")).alias("name"), F.trim("current_version").alias("latest"), "last_checked", "added_at", "id")
    log = log.groupBy("name").agg(F.max_by("latest", F.struct("last_checked", "added_at", "id", "latest")).alias("latest"))
    return held.join(log, "name").where(names.version_order("version", "latest") < 0)


# ---- indicators ------------------------------------------------------------------------------------------------------

#: Indicators made up for the test tables.
_INDICATORS = [
    ("domain", "millrace.example", "feed-a", "confirmed", "2030-01-01T00:00:00Z"),
    ("domain", "dl.osierhub.example", "feed-a", "high", "2024-01-01T00:00:00Z"),
    ("domain", "millrace.example", "feed-b", "medium", None),
    ("package", "quernstone-runtime", "feed-b", "high", "not a time"),
]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _INDICATORS)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "source_urls").select(F.col("first_seen_package_id").alias("subject"), F.lit("domain").alias("kind"), urls.host_of(F.trim("url")).alias("value"), F.lit("source").alias("surface"))
    own = table(spark, d, "packages").select(F.col("id").alias("subject"), F.lit("package").alias("kind"), F.col("name").alias("value"), F.lit("name").alias("surface"))
    return hosts.unionByName(own)


@query(f"""WITH i(kind, value, source, confidence, expires_at) AS (VALUES {_VALUES}),
  f AS (SELECT first_seen_package_id AS subject, 'domain' AS kind, {_HOST} AS value, 'source' AS surface FROM source_urls UNION ALL SELECT id, 'package', name, 'name' FROM packages)
  SELECT f.subject, i.kind, i.value, i.source, min(surface) AS surface, max(confidence) AS confidence, coalesce(try_cast(max(expires_at) AS TIMESTAMPTZ) < TIMESTAMPTZ '2025-07-01 00:00:00+00', false) AS expired
  FROM f JOIN i ON f.kind = i.kind AND (f.value = i.value OR f.kind = 'domain' AND ends_with(f.value, '.' || i.value)) GROUP BY 1, 2, 3, 4""")
def indicator_match(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame(_INDICATORS, "kind string, value string, source string, confidence string, expires_at string")
    return indicators.matches(_facts(spark, d), listed, F.lit("2025-07-01 00:00:00+00").cast("timestamp"))


@query("""SELECT subject, min_by(surface, o) AS surface FROM (
  SELECT id AS subject, 0 AS o, 'maintainer' AS surface FROM packages WHERE lower(current_maintainer) = 'birch_ferret'
  UNION ALL SELECT first_seen_package_id, 1, 'seed' FROM maintainers WHERE lower(name) = 'birch_ferret') GROUP BY 1""")
def pivot_indicator(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "packages").select(F.col("id").alias("subject"), F.lower("current_maintainer").alias("value"))
    seed = table(spark, d, "maintainers").select(F.col("first_seen_package_id").alias("subject"), F.lower("name").alias("value"))
    return indicators.pivot([("maintainer", own), ("seed", seed)], "birch_ferret")


@query(r"""SELECT v AS value, CASE WHEN regexp_matches(v, '^[0-9A-Fa-f]+$') AND length(v) IN (32, 40, 56, 64, 96, 128) THEN 'hash' WHEN regexp_matches(v, '^[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z0-9\-]+\.?$') AND regexp_matches(v, '[A-Za-z]') THEN 'domain' ELSE 'package' END AS kind
  FROM (SELECT name_hash AS v FROM maintainers_hashed WHERE name_hash IS NOT NULL UNION SELECT name FROM packages)""")
def indicator_type(spark: SparkSession, d: str) -> DataFrame:
    values = table(spark, d, "maintainers_hashed").where("name_hash IS NOT NULL").select(F.col("name_hash").alias("value")).union(table(spark, d, "packages").select("name")).distinct()
    return values.withColumn("kind", indicators.indicator_type(F.col("value")))


@query("""WITH p AS (SELECT package_name AS k, array_agg(DISTINCT property_key) FILTER (observed_at < TIMESTAMP '2024-01-01') AS a, array_agg(DISTINCT property_key) FILTER (observed_at >= TIMESTAMP '2024-01-01') AS b FROM package_properties GROUP BY 1)
  SELECT k AS package_name, array_to_string(list_sort(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))), ',') AS gained, array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))), ',') AS lost FROM p""")
def set_delta(spark: SparkSession, d: str) -> DataFrame:
    """Property keys gained and lost per package from 2024 on. A set holds as many members as there are keys."""
    late = F.col("observed_at") >= F.lit("2024-01-01").cast("timestamp_ntz")
    sides = table(spark, d, "package_properties").groupBy("package_name").agg(F.collect_set(F.when(~late, F.col("property_key"))).alias("a"), F.collect_set(F.when(late, F.col("property_key"))).alias("b"))
    joined = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return sides.select("package_name", joined("b", "a").alias("gained"), joined("a", "b").alias("lost"))


@query("""SELECT package_name, array_to_string(list_sort(list(DISTINCT property_key)), ',') AS kept FROM (
  SELECT package_name, property_key FROM package_properties WHERE observed_at < TIMESTAMP '2024-01-01' INTERSECT SELECT package_name, property_key FROM package_properties WHERE observed_at >= TIMESTAMP '2024-01-01') GROUP BY 1""")
def set_common(spark: SparkSession, d: str) -> DataFrame:
    """Property keys that a package has both before and from 2024 on."""
    rows, cut = table(spark, d, "package_properties").select("package_name", "property_key", "observed_at"), F.lit("2024-01-01").cast("timestamp_ntz")
    both = rows.where(F.col("observed_at") < cut).drop("observed_at").intersect(rows.where(F.col("observed_at") >= cut).drop("observed_at"))
    return both.groupBy("package_name").agg(F.array_join(F.array_sort(F.collect_set("property_key")), ",").alias("kept"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events WHERE user_id IS NOT NULL")
def commit_chain(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as a chain of commits, each the child of the one before, ordered by their parents alone."""
    from pyspark.sql import Window

    events = table(spark, d, "events").where("user_id IS NOT NULL")
    given = events.select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("parent_id"))
    return graph.chain_order(given, "event_id", "parent_id").select("event_id", "place")
