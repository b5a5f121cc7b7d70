"""What changed between full snapshots, by signed cells.

Every row of a snapshot becomes key-field-value cells and one presence marker: signed +1 in the comparison with the
snapshot before, -1 in the one with the snapshot after. Cells that are in both snapshots cancel; what is left over
classifies the key and names the changed fields.

The comparisons of a cell lie side by side as bits, 64 in a word, so that a cell is one row for many snapshots, a repeated row
changes nothing, and the sum over a cell's signs is two bit operations. Rows are reduced to (key, digests, word) before they are
shuffled; the second shuffle, by key, carries only what is left, and all cells are summed within it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def held_deliveries(snapshots: DataFrame) -> DataFrame:
    """snapshot_no, delivery_no (the highest, it counts as a whole), prior_no and next_no, the neighbours present, and place among them, from 0.

    One row per snapshot; the window over it sees no row of a snapshot, only this list.
    """
    last = snapshots.where(F.col("snapshot_no").isNotNull()).groupBy("snapshot_no").agg(F.max("delivery_no").alias("delivery_no"))
    order = Window.orderBy("snapshot_no")
    return last.where(F.col("delivery_no").isNotNull()).withColumns({"next_no": F.lead("snapshot_no").over(order), "prior_no": F.lag("snapshot_no").over(order), "place": F.row_number().over(order) - 1})


def _bounded(listed: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The list, to be broadcast if it has at most so many rows and left to the planner beyond, and its number of rows."""
    rows = listed.limit(most + 1).collect()
    if len(rows) > most:
        return listed, listed.count()
    return F.broadcast(listed.sparkSession.createDataFrame(rows, listed.schema)), len(rows)


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(WORD)).cast("int"))


def snapshot_changes(snapshots: DataFrame, key: Column, fields: dict[str, Column], most_listed: int = 100_000) -> DataFrame:
    """Keys added, removed or changed between consecutive snapshots.

    snapshots: snapshot_no, delivery_no and whatever key and fields read. Result: snapshot_no (the later of the two), name,
    change_kind, changed_fields (sorted; empty for added and removed). Rows with a NULL key are dropped; an empty key is
    a key; rows without a snapshot or delivery number are left out. Repeated rows count once. Where one key stands in a snapshot with several values, a field is unchanged if the
    sets of its values are equal. NULL is a value of its own. The first snapshot gives no rows. The list of snapshots (not their rows) is
    broadcast while it has at most most_listed entries.
    """
    listed, n = _bounded(held_deliveries(snapshots).select("snapshot_no", "delivery_no", "place"), most_listed)
    digests = [f"d_{i}" for i in range(len(fields))]
    # A value travels as a 64-bit digest, which keeps long ones out of the shuffle.
    rows = snapshots.select("snapshot_no", "delivery_no", key.alias("name"), *(F.xxhash64(F.lit(i), v.isNull(), v).alias(d) for i, (d, v) in enumerate(zip(digests, fields.values()))))
    rows = rows.where(F.col("name").isNotNull()).join(listed, ["snapshot_no", "delivery_no"])
    # Comparison p is that of the snapshot at place p with the one before: a row is + in its own, - in the next, most often in the same word.
    none = F.lit(0).cast("long")
    word = lambda p: F.floor(p / WORD).cast("int")
    here, then = F.col("place"), F.col("place") + 1
    both = F.array(F.struct(word(here).alias("word"), _bit(here).alias("plus"), _bit(then).alias("minus")))
    apart = F.array(F.struct(word(here).alias("word"), _bit(here).alias("plus"), none.alias("minus")), F.struct(word(then).alias("word"), none.alias("plus"), _bit(then).alias("minus")))
    signed = rows.select("name", *digests, F.explode(F.when(word(here) == word(then), both).otherwise(apart)).alias("s")).select("name", *digests, "s.*")
    signed = signed.groupBy("name", *digests, "word").agg(F.bit_or("plus").alias("plus"), F.bit_or("minus").alias("minus"))
    cells = F.array(F.struct(F.lit(-1).alias("field"), none.alias("value")), *(F.struct(F.lit(i).alias("field"), F.col(d).alias("value")) for i, d in enumerate(digests)))
    cells = signed.repartition("name").select("name", "word", "plus", "minus", F.explode(cells).alias("c"))
    sums = cells.groupBy("name", "word", "c.field", "c.value").agg(F.bit_or("plus").alias("plus"), F.bit_or("minus").alias("minus"))
    sums = sums.select("name", "word", "field", F.col("plus").bitwiseAND(F.bitwise_not("minus")).alias("up"), F.col("minus").bitwiseAND(F.bitwise_not("plus")).alias("down")).where("up <> 0 OR down <> 0")
    mask = lambda field, c: F.coalesce(F.bit_or(F.when(F.col("field") == field, c)), none)
    left = sums.groupBy("name", "word").agg(
        mask(-1, F.col("up")).alias("added"), mask(-1, F.col("down")).alias("removed"), *(mask(i, F.col("up").bitwiseOR(F.col("down"))).alias(f"moved_{i}") for i in range(len(fields)))
    )
    any_ = F.col("added").bitwiseOR(F.col("removed"))
    for i in range(len(fields)):
        any_ = any_.bitwiseOR(F.col(f"moved_{i}"))
    on = lambda c, b: F.getbit(c, b) == 1
    pairs = left.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: on(any_, b))).alias("bit")).withColumn("place", F.col("word") * WORD + F.col("bit"))
    # The first snapshot has none before it, and nothing comes after the last.
    pairs = pairs.where((F.col("place") > 0) & (F.col("place") < n)).join(listed.select("snapshot_no", "place"), "place")
    kind = F.when(on(F.col("added"), F.col("bit")), "added").when(on(F.col("removed"), F.col("bit")), "removed").otherwise("changed")
    moved = F.array_compact(F.array(*(F.when(on(F.col(f"moved_{i}"), F.col("bit")), F.lit(f)) for i, f in enumerate(fields)))) if fields else F.array().cast("array<string>")
    return pairs.withColumn("change_kind", kind).select(
        "snapshot_no", "name", "change_kind", F.when(F.col("change_kind") == "changed", F.array_sort(moved)).otherwise(F.array().cast("array<string>")).alias("changed_fields")
    )
