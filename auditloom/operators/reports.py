"""Findings as text for people: verdicts, change summaries, labels, one JSON body; and the registry's housekeeping."""

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

_ORDER = ("FATAL", "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def verdicts(findings: DataFrame, subject: str, most: int = 5) -> DataFrame:
    """subject, verdict: its severest findings, at most so many, by severity, then by rule. A subject has at most one finding per rule."""
    rank = F.array_position(F.array(*(F.lit(s) for s in _ORDER)), F.col("severity"))
    own = findings.groupBy(subject).agg(F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "rule_id", "severity"))).alias("_f"))
    shown = F.transform(F.slice("_f", 1, most), lambda x: F.concat(x["severity"], F.lit(" "), x["rule_id"]))
    rest = F.size("_f") - most
    return own.select(subject, F.concat(F.array_join(shown, "; "), F.when(rest > 0, F.concat(F.lit(" and "), rest.cast("string"), F.lit(" more"))).otherwise("")).alias("verdict"))


def summary(facts: DataFrame, id_column: str) -> DataFrame:
    """id, changes: what a diff changes, in words, joined by `; `; nothing for nothing."""

    def listed(text: str, c: str) -> Column:
        return F.when(F.size(c) > 0, F.concat(F.lit(text + " "), F.array_join(c, ", ")))

    parts = [
        F.when(~F.col("pkgver_before").eqNullSafe(F.col("pkgver_after")), F.concat(F.lit("version "), F.coalesce("pkgver_before", F.lit("none")), F.lit(" to "), F.coalesce("pkgver_after", F.lit("none")))),
        listed("adds source", "added_urls"), listed("drops source", "removed_urls"), F.when(F.col("sums_removed"), "removes checksums").when(F.col("sums_changed"), "changes checksums"),
        listed("adds dependency", "depends_added"), listed("drops dependency", "depends_removed"), listed("edits", "functions_changed"),
    ]
    return facts.select(id_column, F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "; ").alias("changes"))


def label(score: Column, band: Column, gaps: Column) -> Column:
    """The band as shown: with the score, and what was not read."""
    return F.concat(band, F.format_string(" (%d/100)", score), F.when(gaps != "", F.concat(F.lit(", not read: "), gaps)).otherwise(""))


def body(rows: DataFrame, id_column: str) -> DataFrame:
    """id, report: each row as one JSON object, the same for every surface."""
    return rows.select(id_column, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("report"))


def over_threshold(scores: DataFrame, least: int = 20) -> DataFrame:
    """What is to be reviewed: a score strictly above the threshold."""
    return scores.where(F.col("score") > least)


def without(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """rows without those of the given names (column `name`): forgetting."""
    return rows.join(names.select(F.col("name").alias(key)).distinct(), key, "left_anti")


def untracked(tracked: DataFrame, registry: DataFrame) -> DataFrame:
    """name of what is tracked but no longer in the registry, reserved names (those that begin with two underscores) aside: pruning."""
    return tracked.select("name").where(~F.col("name").startswith("__")).distinct().join(registry.select("name").distinct(), "name", "left_anti")


@pandas_udf(StringType())
def unified_diff(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The unified diff of two texts with three lines of context; '' for equal ones; NULL counts as empty."""
    for old, new in batches:
        yield pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "a/PKGBUILD", "b/PKGBUILD", lineterm="")) for a, b in zip(old, new)], dtype=object)
