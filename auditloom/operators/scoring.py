"""Findings to scores, bands, compositions and calibration figures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a finding of each severity weighs.
WEIGHTS = {"INFO": 0, "LOW": 5, "MEDIUM": 15, "HIGH": 25, "CRITICAL": 40, "FATAL": 0}


def severity_weight(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv)), severity), F.lit(0))


def maturity(n: Column) -> Column:
    """How far an observation count has come to 50, from 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), n / 50.0))


def band(score: Column, high: Column, mature: Column, gaps: Column) -> Column:
    """Low, Medium, High or Critical by score; a high finding lifts Low and Medium to High where it is critical.

    high: the severest finding ('CRITICAL', 'HIGH', else). mature: is there enough history. gaps: is anything unread. Medium
    without history, and Low or Medium with gaps, are Inconclusive unless a finding is HIGH or worse.
    """
    plain = F.when(score <= 20, "Low").when(score <= 50, "Medium").when(score <= 80, "High").otherwise("Critical")
    lifted = F.when((high == "CRITICAL") & plain.isin("Low", "Medium"), "High").otherwise(plain)
    unsure = ~high.isin("HIGH", "CRITICAL") & ((~mature & (lifted == "Medium")) | (gaps & lifted.isin("Low", "Medium")))
    return F.when(unsure, "Inconclusive").otherwise(lifted)


def scores(findings: DataFrame, subject: str) -> DataFrame:
    """Per subject: score (the sum of weights, at most 100, 100 at once for FATAL), n_findings, worst severity.

    findings: subject, rule_id, severity.
    """
    rank = F.array_position(F.array(*(F.lit(s) for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL", "FATAL"))), F.col("severity"))
    out = findings.groupBy(subject).agg(F.sum(severity_weight(F.col("severity"))).alias("_sum"), F.max(F.struct(rank, "severity")).alias("_worst"), F.count(F.lit(1)).alias("n_findings"))
    score = F.when(F.col("_worst.severity") == "FATAL", 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.col("_sum")))).cast("int")
    return out.select(subject, score.alias("score"), "n_findings", F.col("_worst.severity").alias("worst"))


def weighted_scores(findings: DataFrame, subject: str, overrides: dict[str, int] | None = None, modifiers: DataFrame | None = None, novelty: DataFrame | None = None) -> DataFrame:
    """Per subject of any of the inputs: score, n_findings, worst.

    The sum of the findings' weights (by severity, or a rule's own where `overrides` names it), the largest positive modifier (subject,
    modifier), and of each novelty (subject, weight, n) the whole part of weight times maturity(n); between 0 and 100. FATAL is 100 at once.
    """
    weight = severity_weight(F.col("severity"))
    for rule, own in (overrides or {}).items():
        weight = F.when(F.col("rule_id") == rule, own).otherwise(weight)
    rank = F.array_position(F.array(*(F.lit(s) for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL", "FATAL"))), F.col("severity"))
    none = F.lit(None)
    rows = findings.select(subject, weight.cast("long").alias("w"), F.struct(rank, "severity").alias("s"), none.cast("int").alias("m"))
    empty = none.cast(rows.schema["s"].dataType)
    if modifiers is not None:
        rows = rows.unionByName(modifiers.where("modifier > 0").select(subject, none.cast("long").alias("w"), empty.alias("s"), F.col("modifier").cast("int").alias("m")))
    if novelty is not None:
        rows = rows.unionByName(novelty.select(subject, F.floor(F.col("weight") * maturity(F.col("n"))).cast("long").alias("w"), empty.alias("s"), none.cast("int").alias("m")))
    out = rows.groupBy(subject).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"), F.coalesce(F.max("m"), F.lit(0)).alias("m"), F.max("s").alias("s"), F.count("s").alias("n_findings"))
    score = F.when(F.col("s.severity") == "FATAL", 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.col("w") + F.col("m"))))
    return out.select(subject, score.cast("int").alias("score"), "n_findings", F.coalesce("s.severity", F.lit("INFO")).alias("worst"))


def density(findings: DataFrame, subject: str, least: int = 3) -> DataFrame:
    """Subjects whose findings span at least `least` categories: subject, n_categories."""
    return findings.groupBy(subject).agg(F.count_distinct("category").alias("n_categories")).where(F.col("n_categories") >= least)


def stage_chain(findings: DataFrame, subject: str, stages: DataFrame, least: int = 3) -> DataFrame:
    """Subjects whose findings span at least `least` stages: subject, n_stages, stages (sorted, joined by commas).

    stages: rule_id, stage. A subject has at most as many stages as there are in the table.
    """
    own = findings.join(stages, "rule_id").groupBy(subject).agg(F.array_sort(F.collect_set("stage")).alias("_own"))
    return own.where(F.size("_own") >= least).select(subject, F.size("_own").cast("long").alias("n_stages"), F.array_join("_own", ",").alias("stages"))


def suppressed(findings: DataFrame, overrides: DataFrame, subject: str) -> DataFrame:
    """findings with `suppressed`: an override of the rule for this subject (or for all: NULL) applies, unless the finding is FATAL."""
    own = overrides.where(F.col("subject_").isNotNull()).select("rule_id", F.col("subject_").alias(subject), F.lit(True).alias("_a")).distinct()
    every = overrides.where(F.col("subject_").isNull()).select("rule_id", F.lit(True).alias("_b")).distinct()
    joined = findings.join(own, ["rule_id", subject], "left").join(every, "rule_id", "left")
    hit = (F.col("_a").isNotNull() | F.col("_b").isNotNull()) & (F.col("severity") != "FATAL")
    return joined.select(*findings.columns, hit.alias("suppressed"))


def fire_rates(findings: DataFrame, subjects: DataFrame, subject: str, stratum: str) -> DataFrame:
    """Per stratum and rule the share of the stratum's subjects with a finding: stratum, rule_id, n_fired, n_subjects, rate."""
    sizes = subjects.groupBy(stratum).agg(F.count_distinct(subject).alias("n_subjects"))
    fired = findings.join(subjects.select(subject, stratum).distinct(), subject).groupBy(stratum, "rule_id").agg(F.count_distinct(subject).alias("n_fired"))
    return fired.join(sizes, stratum).select(stratum, "rule_id", "n_fired", "n_subjects", F.round(F.col("n_fired") / F.col("n_subjects"), 6).alias("rate"))


def ranks(values: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """Per group two percentiles: nearest_rank, the value at place ceil(q n), and floor_index, the one at place int(q n) counted from 0.

    Equal values are counted first; of each group only its distinct values with counts are ordered.
    """
    from pyspark.sql import Window

    counts = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(line), "total": F.sum("n").over(Window.partitionBy(group))})
    near, index = F.ceil(F.col("total") * q), F.least(F.floor(F.col("total") * q) + 1, F.col("total"))
    return placed.groupBy(group).agg(F.min(F.when(F.col("upto") >= near, F.col(value))).alias("nearest_rank"), F.min(F.when(F.col("upto") >= index, F.col(value))).alias("floor_index"))


def correlation(values: DataFrame, x: str, y: str) -> DataFrame:
    """pearson of two columns, 0 where either doesn't vary."""
    return values.agg(F.round(F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)), 6).alias("pearson"))
