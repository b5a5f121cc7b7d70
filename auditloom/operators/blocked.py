"""Sequential operators whose groups may hold a third of all rows: two levels instead of one window per group.

The rows of a group fall into blocks (say, days). Windows run within (group, block); one small row per block carries what
the next block needs. Only that table of blocks is windowed per group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_block(c: str) -> Column:
    """Blocks of one day of a timestamp; NULL is a block of its own, the first."""
    return F.coalesce(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")), F.lit(-(1 << 31)).cast("int"))


def with_previous(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, name: str) -> DataFrame:
    """df with `name`: a struct that holds `value` of the row before within keys, NULL for the first row.

    order must tell all rows of a group apart for the result to be defined, and block must not fall along it.
    """
    held = F.struct(value.alias("v"))
    rows = df.withColumns({"_k": block, "_v": held})
    inner = F.lag("_v").over(Window.partitionBy(*keys, "_k").orderBy(*order))
    ends = rows.groupBy(*keys, "_k").agg(F.max_by("_v", F.struct(*order)).alias("_e"))
    ends = ends.withColumn("_b", F.lag("_e").over(Window.partitionBy(*keys).orderBy("_k"))).drop("_e")
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*keys, "_k"]]
    joined = rows.withColumn("_i", inner).alias("r").join(ends.alias("e"), match, "left")
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), F.coalesce("r._i", "e._b").alias(name))


def with_index(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """df with `name`: the place of the row within keys, from 0."""
    rows = df.withColumn("_k", block)
    sums = rows.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_o", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy(*keys, "_k").orderBy(*order)) - 1
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*keys, "_k"]]
    joined = rows.withColumn("_i", inner).alias("r").join(sums.alias("e"), match, "left")
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("e._o") + F.col("r._i")).alias(name))
