"""References to records that do not exist, with a skew-aware split.

References are pre-aggregated per table, key and month. Keys that hold more than 1/heavy_keys of all references are heavy;
there are fewer than heavy_keys of them by construction, so they are checked against broadcast targets. The groups of all
other keys go through a shuffled anti-join. Only groups with an orphan are expanded to records. Both halves are united.
"""

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.sources.work import stage_table


def holding_rows(targets: DataFrame) -> DataFrame:
    """One row per id: the one with the latest last_checked (NULL is oldest).

    Rows of one id with the same last_checked are told apart by added_at, then by removed_at, the later (NULL oldest) one holding.
    Columns: id, added_at, removed_at. An id of NULL is no target.
    """
    held = F.max_by(F.struct("added_at", "removed_at"), F.struct("last_checked", "added_at", "removed_at"))
    return targets.where(F.col("id").isNotNull()).groupBy("id").agg(held.alias("h")).select("id", "h.added_at", "h.removed_at")


def _reason(record_at: Column) -> Column:
    return (
        F.when(F.col("id").isNull(), "missing")
        .when(F.col("removed_at").isNotNull(), "deleted")
        .when(F.col("added_at") > record_at, "late")
    )


def live_refs(refs: DataFrame) -> DataFrame:
    """References that can be orphans: NULL and 0 lead nowhere on purpose."""
    return refs.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != 0))


def _groups(refs: DataFrame) -> DataFrame:
    """The references per table, key and month: their number and the times of the earliest and the latest."""
    return refs.groupBy("table_name", "ref_key", "period").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from_at"), F.max("at").alias("to_at"))


def _heavy(groups: DataFrame, heavy_keys: int) -> list[int]:
    """The keys with more than 1/heavy_keys of the references: fewer than heavy_keys values, whatever the data."""
    counts = groups.groupBy("ref_key").agg(F.sum("n").alias("n"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return [r.ref_key for r in counts.where(F.col("n") * heavy_keys > total).select("ref_key").collect()]


def _judged(groups: DataFrame, states: DataFrame) -> DataFrame:
    """Groups with an orphan, their reason and added_at: `cut` where added_at lies between the earliest and the latest record.

    An anti-join drops what a valid target holds as a whole; only what is left over looks up why.
    """
    valid = states.where(F.col("removed_at").isNull())
    orphaned = groups.join(valid, (F.col("ref_key") == valid.id) & F.coalesce(valid.added_at <= F.col("from_at"), valid.added_at.isNull() | F.col("from_at").isNull()), "left_anti")
    found = orphaned.join(states, F.col("ref_key") == states.id, "left")
    whole = _reason(F.col("to_at"))
    reason = F.when(whole.isNotNull(), whole).when(F.col("added_at") > F.col("from_at"), "cut")
    return found.select("table_name", "ref_key", "period", "n", "added_at", reason.alias("reason")).where(F.col("reason").isNotNull())


class Split(NamedTuple):
    """References and their judged groups, light keys and heavy ones apart; heavy is empty if no key is."""

    refs: DataFrame
    judged: DataFrame
    heavy: list[int]


def _split(refs: DataFrame, targets: DataFrame, heavy_keys: int) -> list[Split]:
    refs = live_refs(refs.select("table_name", "record_id", "ref_key", "at")).withColumn("period", F.trunc("at", "month"))
    # Read three times and far smaller than the references: written once.
    groups = stage_table(_groups(refs), "refs")
    heavy = _heavy(groups, heavy_keys)
    states = holding_rows(targets)
    if not heavy:
        return [Split(refs, _judged(groups, states), [])]
    of = lambda df: df.where(F.col("ref_key").isin(heavy))
    rest = lambda df: df.where(~F.col("ref_key").isin(heavy))
    # One row per heavy key at most.
    few = F.broadcast(holding_rows(targets.where(F.col("id").isin(heavy))))
    return [Split(rest(refs), _judged(rest(groups), states), []), Split(of(refs), _judged(of(groups), few), heavy)]


def _records(part: Split, only_cut: bool) -> DataFrame:
    """The references of judged groups, each with its own reason. Groups of heavy keys are broadcast: one per table, heavy key and month."""
    own = part.judged.where(F.col("reason") == "cut") if only_cut else part.judged
    own = own.select(F.col("table_name").alias("t"), F.col("ref_key").alias("k"), F.col("period").alias("p"), "added_at", "reason")
    own = F.broadcast(own) if part.heavy else own
    same = (F.col("ref_key") == F.col("k")) & F.col("table_name").eqNullSafe(F.col("t")) & F.col("period").eqNullSafe(F.col("p"))
    rows = part.refs.join(own, same).where((F.col("reason") != "cut") | (F.col("added_at") > F.col("at")))
    return rows.select("table_name", "record_id", "period", F.when(F.col("reason") == "cut", "late").otherwise(F.col("reason")).alias("reason"))


def orphan_records(refs: DataFrame, targets: DataFrame, heavy_keys: int = 512) -> DataFrame:
    """Each reference without a valid target, with the reason.

    refs: table_name, record_id, ref_key, at (time of the record). targets: id, added_at, removed_at, last_checked; other
    columns are ignored. Result: table_name, record_id, reason; a reference that occurs twice comes out twice. Empty
    targets make every reference `missing`; a NULL time on either side is never `late`; a NULL table or record id is kept as it is.
    Keys and months are judged first; records are read again only to list those of orphaned groups.
    """
    parts = [_records(p, only_cut=False).select("table_name", "record_id", "reason") for p in _split(refs, targets, heavy_keys)]
    return reduce(DataFrame.unionByName, parts)


def orphan_counts(refs: DataFrame, targets: DataFrame, heavy_keys: int = 512) -> DataFrame:
    """Orphans per table, month of the record and reason, from references pre-aggregated per key and month.

    Whole groups are judged by their earliest and latest record; only the groups that a target's added_at cuts in two are
    counted record by record. Result: table_name, period (first day of the month; NULL without a time), reason, n_refs.
    """
    parts = []
    for p in _split(refs, targets, heavy_keys):
        parts.append(p.judged.where(F.col("reason") != "cut").select("table_name", "period", "reason", "n"))
        parts.append(_records(p, only_cut=True).select("table_name", "period", "reason", F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, parts).groupBy("table_name", "period", "reason").agg(F.sum("n").alias("n_refs"))
