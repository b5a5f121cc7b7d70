"""The corpus cycle over consecutive snapshots: what changed, and the detectors over all of it, united into one table of findings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators import corpus

#: Which rule a break of each property is, and how severe.
PROPERTY_RULES = {
    "license": ("R083", "MEDIUM"), "install_hook_present": ("R083", "MEDIUM"), "configure_flags": ("R094", "HIGH"), "depends": ("R095", "HIGH"), "source_hosts": ("R096", "MEDIUM"), "source_orgs": ("R096", "MEDIUM"),
    "version_scheme": ("R097", "INFO"), "pkgdesc_tokens": ("R098", "MEDIUM"), "build_system_markers": ("R102", "MEDIUM"), "build_line_count": ("R102", "MEDIUM"),
}


def cycle_changes(held: DataFrame) -> DataFrame:
    """snapshot_no (the later), name, status (added, modified, removed), maintainer (of the later, '' if removed): held_snapshots compared pair by pair."""
    old = held.where(F.col("next_no").isNotNull()).select(F.col("next_no").alias("snapshot_no"), "name", F.col("version").alias("old_version"), F.lit(True).alias("was"))
    new = held.where(F.col("prior_no").isNotNull()).select("snapshot_no", "name", "version", "maintainer", F.lit(True).alias("now"))
    both = old.join(new, ["snapshot_no", "name"], "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("version").eqNullSafe(F.col("old_version")), "modified")
    return both.withColumn("status", status).where(F.col("status").isNotNull()).select("snapshot_no", "name", "status", F.coalesce("maintainer", F.lit("")).alias("maintainer"))


def _found(rows: DataFrame, rule: str, severity: str, subject: str, n: Column) -> DataFrame:
    return rows.select("snapshot_no", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"), n.cast("long").alias("n"))


def cycle_counts(held: DataFrame) -> DataFrame:
    """snapshot_no, maintainer, k: per snapshot the packages added (maintainer NULL) and those added or modified by each maintainer."""
    changes = cycle_changes(held).where("status <> 'removed'")
    n = F.count(F.lit(1)).alias("k")
    added = changes.where("status = 'added'").groupBy("snapshot_no").agg(n).select("snapshot_no", F.lit(None).cast("string").alias("maintainer"), "k")
    return added.unionByName(changes.where("maintainer <> ''").groupBy("snapshot_no", "maintainer").agg(n))


def corpus_findings(held: DataFrame, adoption: int = 10, burst: int = 5, activity: int = 3, history: int = 3, far: float = 3.0, near: float = 2.0, past: DataFrame | None = None) -> DataFrame:
    """snapshot_no, rule_id, severity, subject, n: every detector over the changes between snapshots.

    R090 another maintainer, R071 one who had no package before, R126 changed hands and version at once (per new maintainer), R092
    `adoption` packages added by one maintainer, R105 `burst` modified by one, R125 packages added far off all snapshots before, R108 a
    maintainer's activity off their own. Deviations need `history` earlier snapshots. Removed packages count for none of them.
    past: cycle_counts() of earlier snapshots than those held, so that two snapshots are enough to judge the newest.
    """
    changes = cycle_changes(held).where("status <> 'removed'")
    moves = corpus.transitions(held).where("new_maintainer <> ''")
    one = F.lit(1)
    by = lambda rows: rows.where("maintainer <> ''").groupBy("snapshot_no", "maintainer").agg(F.count(F.lit(1)).alias("k"))
    added, modified = changes.where("status = 'added'"), changes.where("status = 'modified'")
    counts = cycle_counts(held)
    counts = counts if past is None else counts.unionByName(past.select(*counts.columns))
    introduced = corpus.period_deviation(counts.where("maintainer IS NULL").drop("maintainer"), [], "snapshot_no", "k", history)
    active = corpus.period_deviation(counts.where("maintainer IS NOT NULL"), ["maintainer"], "snapshot_no", "k", history)
    parts = [
        _found(moves, "R090", "MEDIUM", "name", one),
        _found(corpus.takeovers(held), "R071", "HIGH", "name", one),
        _found(corpus.adopt_then_modify(held), "R126", "MEDIUM", "new_maintainer", F.col("n_packages")),
        _found(by(added).where(F.col("k") >= adoption), "R092", "HIGH", "maintainer", F.col("k")),
        _found(by(modified).where(F.col("k") >= burst), "R105", "MEDIUM", "maintainer", F.col("k")),
        _found(introduced.where((F.col("k") >= activity) & (F.col("deviation") >= far)), "R125", "MEDIUM", "snapshot_no", F.col("k")),
        _found(active.where((F.col("k") >= activity) & (F.col("deviation") >= near)), "R108", "MEDIUM", "maintainer", F.col("k")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def property_findings(breaks: DataFrame) -> DataFrame:
    """breaks with the rule_id and severity of their property; properties without a rule are left out."""
    rule = F.create_map(*(F.lit(x) for k, (r, _) in PROPERTY_RULES.items() for x in (k, r)))
    severity = F.create_map(*(F.lit(x) for k, (_, s) in PROPERTY_RULES.items() for x in (k, s)))
    return breaks.withColumns({"rule_id": F.element_at(rule, F.col("property_key")), "severity": F.element_at(severity, F.col("property_key"))}).where(F.col("rule_id").isNotNull())


def bumped(scores: DataFrame, members: DataFrame) -> DataFrame:
    """subject, score: profile scores raised by the weights of the findings that name the subject (members: subject, weight), at most 100.

    All weights add up, in whatever order the findings come.
    """
    more = members.groupBy("subject").agg(F.sum("weight").alias("_w"))
    return scores.join(more, "subject", "left").select("subject", F.least(F.lit(100), F.col("score") + F.coalesce("_w", F.lit(0))).cast("int").alias("score"))


def temporal(rows: DataFrame, as_of: Column, previous: str = "previous_at") -> DataFrame:
    """rows (first_at, last_at, previous_at) with flags: very_recent (changed within 72 hours), brand_new (first seen within 30 days), revived (more than 365 days after the change before)."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    now = F.unix_seconds(as_of.cast("timestamp"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns(
        {"very_recent": flag(now - seconds("last_at") < 72 * 3600), "brand_new": flag(now - seconds("first_at") < 30 * 86400), "revived": flag(seconds("last_at") - seconds(previous) > 365 * 86400)}
    )
