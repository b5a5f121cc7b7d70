"""Queries of the line engine: lines, rules, findings, scores, coverage."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import dataflow, diffs, rules, scoring, trees
from auditloom.operators.rules import Rule
from auditloom.sources import stage_table, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


#: Rules over any text, in the part of regular expressions that Java and RE2 share: what the SQL says too.
TEXT_RULES = (
    Rule("L001", "Url", "https?://", "LOW", "network", "raw", stage="delivery"),
    Rule("L002", "Build command", r"\bmake\b", "INFO", "build", "raw", stage="execution"),
    Rule("L003", "Digest", "[0-9a-f]{32,}", "LOW", "integrity", "raw", stage="delivery"),
    Rule("L004", "Configure", r"\./configure", "MEDIUM", "build", "raw", stage="execution"),
    Rule("L005", "Package root", r"\$\{?pkgdir", "MEDIUM", "staging", "raw", stage="staging"),
    Rule("L006", "Network access", "network access", "HIGH", "network", "raw", stage="exfiltration"),
    Rule("L007", "Signing key", "signing key|clave|clé de signature", "MEDIUM", "integrity", "raw", stage="evasion"),
    Rule("L008", "Rewritten", "rewritten from scratch|dropped without a word", "CRITICAL", "takeover", "raw", stage="persistence"),
)

_RULES = ", ".join(f"('{r.id}', '{r.pattern}', '{r.severity}', '{r.category}', '{r.stage}')" for r in TEXT_RULES)
_LINES = r"""
WITH t AS (SELECT doc_id, source, n_chars, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0),
lines AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS idx, unnest(l) AS body FROM t)
"""
_FINDINGS = _LINES + f""", rules(rule_id, pattern, severity, category, stage) AS (VALUES {_RULES}),
findings AS (
  SELECT doc_id, rule_id, severity, category, stage, min(idx) AS idx FROM lines JOIN rules ON regexp_matches(body, '(?i)' || pattern) AND NOT regexp_matches(body, '^[ \\t]*#') GROUP BY ALL),
weighed AS (SELECT *, CASE severity WHEN 'LOW' THEN 5 WHEN 'MEDIUM' THEN 15 WHEN 'HIGH' THEN 25 WHEN 'CRITICAL' THEN 40 ELSE 0 END AS w,
  CASE severity WHEN 'INFO' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 WHEN 'CRITICAL' THEN 5 END AS r FROM findings),
scores AS (SELECT doc_id, CAST(least(100, sum(w)) AS INTEGER) AS score, count(*) AS n_findings, max_by(severity, r) AS worst FROM weighed GROUP BY 1)
""".replace("\\\\t", "\\t")


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return diffs.text_lines(table(spark, d, "documents"), "doc_id", "text")


def _as_diff(lines: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return lines.withColumns({"side": F.lit("+"), "resolved": none, "file": none, "lineno": F.lit(None).cast("int"), "context": F.lit("other"), "function": none, "callers": F.array().cast("array<string>")})


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.findings(_as_diff(text_lines(spark, d)), "doc_id", TEXT_RULES)


def _stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.id, r.stage) for r in TEXT_RULES], "rule_id string, stage string")


@query(_LINES + "SELECT doc_id, idx, body FROM lines")
def line_split(spark: SparkSession, d: str) -> DataFrame:
    return text_lines(spark, d)


@query(_LINES + r""", h AS (
  SELECT *, try_cast(nullif(regexp_extract(body, '^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)', 1), '') AS INTEGER) AS hunk, nullif(regexp_extract(body, '^\+\+\+ (?:[ab]/)?([^\t]*)', 1), '') AS named,
         regexp_matches(body, '^(?:@@ |\+\+\+ |--- )') AS header FROM lines),
s AS (SELECT *, last_value(named IGNORE NULLS) OVER w AS file, last_value(CASE WHEN hunk IS NOT NULL THEN idx END IGNORE NULLS) OVER w AS h_idx, last_value(hunk IGNORE NULLS) OVER w AS h_at FROM h
  WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, idx, file, CASE WHEN NOT header AND NOT starts_with(body, '-') THEN CAST(h_at + sum(CASE WHEN NOT header AND NOT starts_with(body, '-') AND h_idx IS NOT NULL THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, h_idx ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS INTEGER) END AS lineno FROM s""")
def line_numbering(spark: SparkSession, d: str) -> DataFrame:
    return diffs.numbered(text_lines(spark, d), "doc_id")


@query(_LINES + r""", o AS (SELECT doc_id, idx, coalesce(NOT lag(regexp_matches(body, '(^|[^\\])(\\\\)*\\$')) OVER (PARTITION BY doc_id ORDER BY idx), true) AS starts FROM lines),
  g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS grp FROM o)
  SELECT doc_id, min(idx) AS idx, count(*) AS n_lines FROM g GROUP BY doc_id, grp""")
def line_continuation(spark: SparkSession, d: str) -> DataFrame:
    return diffs.continued(text_lines(spark, d), "doc_id")


@query(_FINDINGS + "SELECT doc_id, rule_id, severity, category, idx FROM findings")
def line_rules_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).select("doc_id", "rule_id", "severity", "category", "idx")


@query(_FINDINGS + "SELECT * FROM scores")
def scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scores(_findings(spark, d), "doc_id")


@query(_FINDINGS + """, known AS (SELECT package_name, count(*) AS n FROM documents GROUP BY 1),
  own AS (SELECT doc_id, CASE rule_id WHEN 'L003' THEN 12 ELSE w END AS w, r, severity FROM weighed),
  extra AS (SELECT doc_id, max(CASE source WHEN 'comment' THEN 7 WHEN 'note' THEN 3 ELSE 0 END) AS m FROM documents GROUP BY 1),
  fresh AS (SELECT doc_id, sum(CAST(floor(20 * least(1.0, n / 50.0)) AS BIGINT)) AS w FROM documents JOIN known USING (package_name) WHERE package_name IS NOT NULL GROUP BY 1),
  sums AS (SELECT doc_id, sum(w) AS w, count(*) AS n_findings, max_by(severity, r) AS worst FROM own GROUP BY 1),
  ids AS (SELECT doc_id FROM sums UNION SELECT doc_id FROM extra WHERE m > 0 UNION SELECT doc_id FROM fresh)
  SELECT doc_id, CAST(least(100, coalesce(s.w, 0) + coalesce(e.m, 0) + coalesce(f.w, 0)) AS INTEGER) AS score, coalesce(n_findings, 0) AS n_findings, coalesce(worst, 'INFO') AS worst
  FROM ids LEFT JOIN sums s USING (doc_id) LEFT JOIN extra e USING (doc_id) LEFT JOIN fresh f USING (doc_id)""")
def weighted_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores with a rule's own weight, a modifier by source and the novelty of a package by how often it is named."""
    docs = table(spark, d, "documents")
    known = docs.where("package_name IS NOT NULL").groupBy("package_name").agg(F.count(F.lit(1)).alias("n"))
    modifiers = docs.select("doc_id", F.when(F.col("source") == "comment", 7).when(F.col("source") == "note", 3).otherwise(0).alias("modifier"))
    novelty = docs.join(known, "package_name").select("doc_id", F.lit(20).alias("weight"), "n")
    return scoring.weighted_scores(_findings(spark, d), "doc_id", {"L003": 12}, modifiers, novelty)


@query(_LINES + r""", o AS (SELECT *, regexp_matches(body, '(^|[^\\])(\\\\)*\\$') AS open FROM lines),
  s AS (SELECT *, coalesce(NOT lag(open) OVER (PARTITION BY doc_id ORDER BY idx), true) AS starts FROM o), g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS grp FROM s),
  w AS (SELECT doc_id, grp, trim(string_agg(CASE WHEN open THEN body[:-2] || ' ' ELSE body END, '' ORDER BY idx), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM g GROUP BY 1, 2)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS idx, body FROM w WHERE body <> ''""")
def line_compact(spark: SparkSession, d: str) -> DataFrame:
    return diffs.compacted(text_lines(spark, d), "doc_id")


_BAND = """, planned AS (SELECT s.*, d.package_name, len(d.text) > 1500 AS gaps, coalesce(m.n, 0) >= 5 AS mature FROM scores s JOIN documents d USING (doc_id)
  LEFT JOIN (SELECT package_name, count(*) AS n FROM documents GROUP BY 1) m ON m.package_name = d.package_name),
plain AS (SELECT *, CASE WHEN score <= 20 THEN 'Low' WHEN score <= 50 THEN 'Medium' WHEN score <= 80 THEN 'High' ELSE 'Critical' END AS b FROM planned),
lifted AS (SELECT *, CASE WHEN worst = 'CRITICAL' AND b IN ('Low', 'Medium') THEN 'High' ELSE b END AS l FROM plain)
"""


@query(_FINDINGS + _BAND + """SELECT doc_id, score, worst, CASE WHEN worst NOT IN ('HIGH', 'CRITICAL') AND (NOT mature AND l = 'Medium' OR gaps AND l IN ('Low', 'Medium')) THEN 'Inconclusive' ELSE l END AS band FROM lifted""")
def score_and_band(spark: SparkSession, d: str) -> DataFrame:
    """Documents' scores as bands; a package is known well from five documents on, a long text counts as not read in full."""
    docs = table(spark, d, "documents")
    known = docs.where("package_name IS NOT NULL").groupBy("package_name").agg(F.count(F.lit(1)).alias("n"))
    rows = scoring.scores(_findings(spark, d), "doc_id").join(docs.select("doc_id", "package_name", (F.length("text") > 1500).alias("gaps")), "doc_id").join(known, "package_name", "left")
    return rows.select("doc_id", "score", "worst", scoring.band(F.col("score"), F.col("worst"), F.coalesce(F.col("n") >= 5, F.lit(False)), F.col("gaps")).alias("band"))


@query(_FINDINGS + "SELECT doc_id, count(DISTINCT category) AS n_categories FROM findings GROUP BY 1 HAVING count(DISTINCT category) >= 3")
def capability_density(spark: SparkSession, d: str) -> DataFrame:
    return scoring.density(_findings(spark, d), "doc_id")


@query(_FINDINGS + "SELECT doc_id, count(DISTINCT stage) AS n_stages, array_to_string(list_sort(list(DISTINCT stage)), ',') AS stages FROM findings GROUP BY 1 HAVING count(DISTINCT stage) >= 3")
def stage_chain(spark: SparkSession, d: str) -> DataFrame:
    return scoring.stage_chain(_findings(spark, d), "doc_id", _stages(spark))


@query(_FINDINGS + "SELECT doc_id, rule_id, severity, category, idx, rule_id = 'L001' OR rule_id = 'L007' AND doc_id = 10 AS suppressed FROM findings")
def override_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Findings of L001 are overridden everywhere, those of L007 for document 10."""
    overrides = spark.createDataFrame([("L001", None), ("L007", 10)], "rule_id string, subject_ long")
    return scoring.suppressed(_findings(spark, d).select("doc_id", "rule_id", "severity", "category", "idx"), overrides, "doc_id")


@query(_FINDINGS + """, n AS (SELECT source, count(DISTINCT doc_id) AS n_subjects FROM documents WHERE source IS NOT NULL GROUP BY 1),
  f AS (SELECT source, rule_id, count(DISTINCT doc_id) AS n_fired FROM findings JOIN documents USING (doc_id) GROUP BY 1, 2)
  SELECT source, rule_id, n_fired, n_subjects, round(n_fired / n_subjects, 6) AS rate FROM f JOIN n USING (source)""")
def fire_rate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.fire_rates(_findings(spark, d), table(spark, d, "documents").where("source IS NOT NULL"), "doc_id", "source")


@query("""WITH o AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL AND source IS NOT NULL)
  SELECT source, min(n_chars) FILTER (i >= ceil(n * 0.95)) AS nearest_rank, min(n_chars) FILTER (i >= least(floor(n * 0.95) + 1, n)) AS floor_index FROM o GROUP BY 1""")
def percentile_gate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.ranks(table(spark, d, "documents").where("source IS NOT NULL"), "source", "n_chars", 0.95)


@query(_FINDINGS + "SELECT round(coalesce(corr(score, n_chars), 0.0), 6) AS pearson FROM scores JOIN documents USING (doc_id)")
def score_size_corr(spark: SparkSession, d: str) -> DataFrame:
    return scoring.correlation(scoring.scores(_findings(spark, d), "doc_id").join(table(spark, d, "documents"), "doc_id"), "score", "n_chars")


_SRCINFO = _LINES + r""", p AS (SELECT doc_id, idx, regexp_extract(body, '^[ \t]*([a-z0-9_]+) = (.*\S)', 1) AS key, regexp_extract(body, '^[ \t]*([a-z0-9_]+) = (.*\S)', 2) AS value FROM lines),
f AS (SELECT doc_id, key, value, min(idx) AS idx FROM p WHERE key <> '' GROUP BY ALL)
"""


@query(_SRCINFO + "SELECT doc_id, key, CAST(row_number() OVER (PARTITION BY doc_id, key ORDER BY idx) AS INTEGER) AS place, value FROM f")
def srcinfo_parse(spark: SparkSession, d: str) -> DataFrame:
    return diffs.srcinfo(table(spark, d, "documents"), "doc_id", "text")


@query(_SRCINFO + """, o AS (SELECT DISTINCT key, value FROM f WHERE doc_id % 2 = 0), n AS (SELECT DISTINCT key, value FROM f WHERE doc_id % 2 = 1)
  SELECT coalesce(o.key, n.key) AS key, coalesce(o.value, n.value) AS value, CASE WHEN o.key IS NULL THEN 'added' ELSE 'removed' END AS change FROM o FULL JOIN n ON o.key = n.key AND o.value = n.value WHERE o.key IS NULL OR n.key IS NULL""")
def srcinfo_delta(spark: SparkSession, d: str) -> DataFrame:
    """Values that only documents of even or only those of odd number hold, as the old and the new side."""
    rows = diffs.srcinfo(table(spark, d, "documents"), "doc_id", "text")
    return diffs.delta(rows.where("doc_id % 2 = 0").select("key", "value"), rows.where("doc_id % 2 = 1").select("key", "value"), ["key"], "value")


@query()
def resolve_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document read as a diff, with scope and resolved text."""
    return diffs.diff_lines(table(spark, d, "documents"), "doc_id", "text")


@query()
def diff_facts(spark: SparkSession, d: str) -> DataFrame:
    return diffs.diff_facts(table(spark, d, "documents"), "doc_id", "text")


#: The stages of rules that are no Rule of the catalogue.
_OTHER_STAGES = {
    "X009": "delivery", "X016": "delivery", "R129": "delivery", "R080": "delivery", "X023": "execution", "R120": "execution", "R121": "execution", "R124": "execution", "R136": "execution", "R137": "execution", "R138": "execution",
    "R082": "evasion", "R147": "evasion", "R068": "persistence",
}


def composed(found: DataFrame, id_column: str) -> DataFrame:
    """Findings that follow from others of a diff: id, rule_id, severity, category. R072 three categories, R089 three stages, X007 two techniques of evasion."""
    stages = found.sparkSession.createDataFrame([*((r.id, r.stage) for r in rules.RULES if r.stage), *_OTHER_STAGES.items()], "rule_id string, stage string")
    evasion = found.where("rule_id LIKE 'X%'").groupBy(id_column).agg(F.count_distinct("rule_id").alias("n")).where("n >= 2")
    made = ((scoring.density(found, id_column), "R072", "INFO", "meta"), (scoring.stage_chain(found, id_column, stages), "R089", "INFO", "meta"), (evasion, "X007", "CRITICAL", "evasion"))
    first, *rest = (df.select(id_column, F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(c).alias("category")) for df, i, s, c in made)
    for df in rest:
        first = first.unionByName(df)
    return first


def audit(docs: DataFrame, id_column: str, text_column: str, tree: DataFrame | None = None, others: DataFrame | None = None, notes: DataFrame | None = None, rule_set: tuple[Rule, ...] = rules.RULES) -> DataFrame:
    """Diffs to scores: findings of lines, whole diffs, flows, payloads, trees, the registry and compositions, united, scored, banded, with what could not be read.

    tree: id, path and, if there, head and content of the files committed beside each diff. others: id, rule_id, severity, category; what
    further detectors found of the same ids (registry, graph, adoption, indicators). notes: id, gap, see coverage_gaps. Result: the id,
    score, n_findings, worst, band, rules (sorted), gaps. Diffs without a finding have score 0; findings and notes of other ids are left out.
    """
    lines, facts, actions = dataflow.diff_parts(docs, id_column, text_column)
    own = [rules.findings(lines, id_column, rule_set), rules.structural(facts, id_column), dataflow.flow_findings(actions, id_column, tree)]
    if tree is not None and "head" in tree.columns:
        own.append(trees.tree_findings(tree, id_column, actions.where("kind = 'declared'")))
    if others is not None:
        own.append(others.join(facts.select(id_column), id_column, "left_semi"))
    found = stage_table(reduce(DataFrame.unionByName, (f.select(id_column, "rule_id", "severity", "category") for f in own)).distinct(), "findings")
    found = stage_table(found.unionByName(composed(found, id_column)), "composed")
    # A diff has at most one finding of each rule, so the lists are as long as the catalogue.
    named = found.groupBy(id_column).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"))
    scored = facts.select(id_column).join(scoring.scores(found, id_column), id_column, "left").join(named, id_column, "left").join(diffs.coverage_gaps(facts, id_column, notes), id_column, "left")
    filled = scored.select(
        id_column, F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("n_findings", F.lit(0).cast("long")).alias("n_findings"), F.coalesce("worst", F.lit("INFO")).alias("worst"), F.coalesce("rules", F.lit("")).alias("rules"),
        F.coalesce(F.array_join("gaps", ","), F.lit("")).alias("gaps"),
    )
    return filled.withColumn("band", scoring.band(F.col("score"), F.col("worst"), F.lit(True), F.col("gaps") != ""))


@query()
def diff_audit(spark: SparkSession, d: str) -> DataFrame:
    return audit(table(spark, d, "documents"), "doc_id", "text")
