"""Corpus-wide detectors over registry snapshots, logs and observations.

Groups are reported as counts and spans, members as rows, so that no group is ever gathered in one place.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import name_key
from auditloom.operators.blocked import day_block, with_index, with_previous
from auditloom.operators.snapshot_delta import held_deliveries


def held_snapshots(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot and package: snapshot_no, prior_no, next_no, name, version, maintainer ('' for none).

    Names and maintainers are trimmed and in lower case. Rows that repeat a name within a snapshot are one, of the greatest
    (version, maintainer); rows without a name are left out.
    """
    rows = snapshots.join(held_deliveries(snapshots), ["snapshot_no", "delivery_no"]).where(F.col("name").isNotNull())
    state = F.max(F.struct(F.trim("current_version").alias("version"), F.coalesce(name_key(F.col("current_maintainer")), F.lit("")).alias("maintainer")))
    held = rows.groupBy("snapshot_no", "prior_no", "next_no", name_key(F.col("name")).alias("name")).agg(state.alias("s"))
    return held.select("snapshot_no", "prior_no", "next_no", "name", "s.version", "s.maintainer")


def transitions(held: DataFrame) -> DataFrame:
    """Packages that are in two consecutive snapshots under different maintainers: snapshot_no (the later), name, old and new maintainer, versions, kind."""
    old = held.where(F.col("next_no").isNotNull()).select(F.col("next_no").alias("snapshot_no"), "name", F.col("maintainer").alias("old_maintainer"), F.col("version").alias("old_version"))
    new = held.select("snapshot_no", "name", F.col("maintainer").alias("new_maintainer"), F.col("version").alias("new_version"))
    kind = F.when(F.col("new_maintainer") == "", "orphaned").when(F.col("old_maintainer") == "", "adopted").otherwise("transferred")
    return old.join(new, ["snapshot_no", "name"]).where(F.col("old_maintainer") != F.col("new_maintainer")).withColumn("kind", kind)


def takeovers(held: DataFrame) -> DataFrame:
    """Transitions to a maintainer who had no package in the snapshot before."""
    known = held.where(F.col("next_no").isNotNull() & (F.col("maintainer") != "")).select(F.col("next_no").alias("snapshot_no"), F.col("maintainer").alias("new_maintainer")).distinct()
    return transitions(held).where(F.col("new_maintainer") != "").join(known, ["snapshot_no", "new_maintainer"], "left_anti")


def adopt_then_modify(held: DataFrame) -> DataFrame:
    """Per snapshot and new maintainer, how many packages changed hands and version at once."""
    both = transitions(held).where((F.col("new_maintainer") != "") & ~F.col("old_version").eqNullSafe(F.col("new_version")))
    return both.groupBy("snapshot_no", "new_maintainer").agg(F.count(F.lit(1)).alias("n_packages"), F.min("name").alias("first_name"))


def span_groups(rows: DataFrame, key: str, at: str, least: int, window: str) -> DataFrame:
    """Groups of at least `least` rows whose whole span lies within the window: key, n, first_at, last_at. NULL and empty keys and NULL times don't count."""
    known = rows.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "") & F.col(at).isNotNull())
    groups = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return groups.where((F.col("n") >= least) & (F.col("last_at") <= F.col("first_at") + F.expr(f"INTERVAL {window}")))


def shared_keys(rows: DataFrame, key: str, member: str, base: str, least: int) -> DataFrame:
    """Keys that at least `least` distinct members of as many distinct bases share: key, n_members, n_bases."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(member).alias("n_members"), F.count_distinct(base).alias("n_bases"))
    return counts.where((F.col("n_members") >= least) & (F.col("n_bases") >= least))


def _deviation(n: Column, mean: Column, deviation: Column) -> Column:
    """How far n is from its history: in standard deviations, or relative to the mean (1 at least) where there is no spread."""
    return F.when(deviation > 0, (n - mean) / deviation).otherwise((n - mean) / F.greatest(mean, F.lit(1.0)))


def period_deviation(counts: DataFrame, keys: list[str], period: str, n: str, history: int = 3) -> DataFrame:
    """Per key and period the deviation of its count from all earlier periods of the key, once there are `history` of them.

    One row per key and period goes in, so a group has as many rows as there are periods.
    """
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    known = counts.withColumns({"n_before": F.count(n).over(before), "mean": F.avg(n).over(before), "sd": F.stddev_samp(n).over(before)})
    known = known.where(F.col("n_before") >= history)
    return known.select(*keys, period, n, "n_before", F.round(_deviation(F.col(n), F.col("mean"), F.col("sd")), 6).alias("deviation"))


def first_occurrences(rows: DataFrame, key: str, group: str, order: list[str]) -> DataFrame:
    """rows with first_global and first_in_group: is this the first row of its key, and of its key within its group.

    Least rows by aggregation, not by sorting groups. NULL keys are never first.
    """
    least = lambda *by: rows.where(F.col(key).isNotNull()).groupBy(*by).agg(F.min(F.struct(*order)).alias("_f"))
    own = F.struct(*order)
    everywhere = least(key).select(F.col(key).alias("_gk"), F.col("_f").alias("_g"))
    inside = least(group, key).select(F.col(group).alias("_lg"), F.col(key).alias("_lk"), F.col("_f").alias("_l"))
    joined = rows.join(everywhere, F.col(key) == F.col("_gk"), "left").join(inside, (F.col(key) == F.col("_lk")) & F.col(group).eqNullSafe(F.col("_lg")), "left")
    return joined.withColumns({"first_global": F.coalesce(own == F.col("_g"), F.lit(False)), "first_in_group": F.coalesce(own == F.col("_l"), F.lit(False))}).drop("_gk", "_g", "_lg", "_lk", "_l")


def gaps(rows: DataFrame, keys: list[str], at: str, tie: str, longer_than_days: int) -> DataFrame:
    """Rows that come more than so many days after the row before of their key: the row, previous_at, gap_days."""
    known = with_previous(rows.where(F.col(at).isNotNull()), keys, [at, tie], day_block(at), F.col(at), "_p")
    seconds = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.col("_p.v").cast("timestamp"))
    days = F.floor(seconds / 86400)
    return known.where(seconds > 86400 * longer_than_days).select(*rows.columns, F.col("_p.v").alias("previous_at"), days.alias("gap_days"))


def bursts(rows: DataFrame, keys: list[str], at: str, tie: str, least: int) -> DataFrame:
    """Rows by which a key reaches at least `least` rows within the 24 hours up to it: the row and n_in_24h.

    The row `least`-1 places before tells: its place is looked up by a join, so no window spans a group.
    """
    known = with_index(rows.where(F.col(at).isNotNull()), keys, [at, tie], day_block(at), "_n")
    earlier = known.select(*keys, (F.col("_n") + least - 1).alias("_n"), F.col(at).alias("_then"))
    reached = known.join(earlier, [*keys, "_n"]).where(F.col("_then") >= F.col(at) - F.expr("INTERVAL 24 HOURS"))
    return reached.select(*rows.columns, F.col("_then").alias("since"))


def property_breaks(rows: DataFrame, keys: list[str], order: list[str], block: Column, value: str, floor: int) -> DataFrame:
    """Values that change after they held for at least `floor` further observations.

    Result: keys, order, old_value, new_value, stable_for_n, weight. An observation equal to the one before adds 1 to
    stable_for_n, a change starts at 0; the weight is 1 - 1/(1 + (n-floor+1)^0.7).
    """
    placed = with_index(rows, keys, order, block, "_n")
    changed = with_previous(placed, keys, order, block, F.col(value), "_p").where(F.col("_p").isNull() | ~F.col("_p.v").eqNullSafe(F.col(value)))
    ended = with_previous(changed, keys, order, block, F.struct(F.col("_n").alias("n"), F.col(value).alias("old")), "_q").where(F.col("_q").isNotNull())
    n = F.col("_n") - F.col("_q.v.n") - 1
    weight = F.round(F.least(F.lit(1.0), 1 - 1 / (1 + F.pow(n - floor + 1, F.lit(0.7)))), 6)
    return ended.where(n >= floor).select(*keys, *order, F.col("_q.v.old").alias("old_value"), F.col(value).alias("new_value"), n.cast("long").alias("stable_for_n"), weight.alias("weight"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row with the greatest order (NULL is least), by partial aggregation; ties by the other columns."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return best.select(*keys, *(f"_m.{c}" for c in [*order, *rest])).select(*rows.columns)


def newest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n greatest rows by order of each key, with rank from 1. Each key's n best are found within salts first."""
    salt = F.pmod(F.xxhash64(*order), F.lit(16))
    down = [F.col(c).desc_nulls_last() for c in order]
    first = rows.withColumn("_s", salt).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*down))).where(F.col("rank") <= n).drop("_s", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*down))).where(F.col("rank") <= n)


def alerts(findings: DataFrame, at: str) -> DataFrame:
    """One row per subject and rule: first_sent, last_sent, times."""
    return findings.groupBy("subject", "rule_id").agg(F.min(at).alias("first_sent"), F.max(at).alias("last_sent"), F.count(F.lit(1)).alias("times"))


def seed_merge(rows: DataFrame) -> DataFrame:
    """Delivered identity rows as one per name_hash: the last non-NULL email by arrival, least first_seen, summed counts, united packages.

    Packages are counted, not gathered: n_packages is the number of distinct ones. NULL and blank hashes are left out.
    """
    base = rows.groupBy("name_hash").agg(
        F.max(F.when(F.col("email_hash").isNotNull(), F.struct("row_id", "email_hash"))).alias("e"), F.min("first_seen").alias("first_seen"), F.sum("package_count").cast("long").alias("package_count")
    )
    members = rows.select("name_hash", F.explode("packages").alias("p")).groupBy("name_hash").agg(F.count_distinct("p").alias("n_packages"))
    return base.join(members, "name_hash", "left").select("name_hash", F.col("e.email_hash").alias("email_hash"), "first_seen", "package_count", F.coalesce("n_packages", F.lit(0).cast("long")).alias("n_packages"))
