"""Full history of changing attributes, kept as checkpoints and patches.

Observations are range-partitioned once, by entity, property, time and arrival, so that one entity or even one moment with a third
of all rows is spread over many partitions. Each partition reads its rows in that order, of one moment only the last, and writes, per
property, a full version (checkpoint) first and after every `checkpoint_every` versions, and in between patches with only the
attributes that changed. Its last moment, which the next partition may go on with, becomes a part of its own. Validity rows are
reconstructed by folding patches forward from the nearest checkpoint; two small rows per partition (its edges) drop moments
that are superseded and stitch versions that continue across partitions.
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions.text import epoch_seconds
from auditloom.sources.work import stage_table

ATTRIBUTES = ("value", "stable_for_n", "first_seen", "last_changed")
_STORE = (
    "part int, seq long, row_kind string, segment long, package_name string, property_key string, digest string, observed_at timestamp,"
    "changed array<string>, value string, stable_for_n long, first_seen string, last_changed string,"
    "tail_package string, tail_property string, tail_digest string, second_changed string"
)


def canonical_value(text: str) -> str:
    """One spelling per value: JSON arrays as sorted sets, booleans in lower case, strings without quotes, no outer white space.

    >>> canonical_value(' ["b", "a", "b"]') == canonical_value('["a","b"]'), canonical_value('"TRUE"'), canonical_value(' x ') == canonical_value('"x"')
    (True, 'b:true', True)
    """
    return _canonical(text.strip()).encode("utf-8", "backslashreplace").decode()


def _canonical(t: str) -> str:
    if t[:1] == "[":
        try:
            items = json.loads(t)
            if isinstance(items, list):
                return "[" + ",".join(sorted({json.dumps(x, sort_keys=True, ensure_ascii=False) for x in items})) + "]"
        except (ValueError, RecursionError):
            return "s:" + t
    if len(t) >= 2 and t[0] == t[-1] == '"':
        try:
            inner = json.loads(t)
            t = inner if isinstance(inner, str) else t
        except ValueError:
            t = t[1:-1]
        t = t.strip()
    return "b:" + t.lower() if t.lower() in ("true", "false") else "s:" + t


def observations(properties: DataFrame) -> DataFrame:
    """Rows that count: a value and a time are there."""
    fields = [F.col(c).cast("long" if c == "stable_for_n" else "string").alias(c) for c in ATTRIBUTES]
    return properties.where(F.col("value").isNotNull() & F.col("observed_at").isNotNull()).select("package_name", "property_key", "observed_at", F.col("obs_id").cast("long").alias("obs_id"), *fields)


_SCHEMA = pa.schema(
    [("part", pa.int32()), ("seq", pa.int64()), ("row_kind", pa.string()), ("segment", pa.int64()), ("package_name", pa.string()), ("property_key", pa.string()),
     ("digest", pa.string()), ("observed_at", pa.timestamp("us", tz="UTC")), ("changed", pa.list_(pa.string())), ("value", pa.string()), ("stable_for_n", pa.int64()),
     ("first_seen", pa.string()), ("last_changed", pa.string()), ("tail_package", pa.string()), ("tail_property", pa.string()), ("tail_digest", pa.string()), ("second_changed", pa.string())]
)
_MOMENT = ("package_name", "property_key", "observed_at")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if name != "observed_at" else batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _differs(values: np.ndarray) -> np.ndarray:
    """Of each value but the first, whether it differs from the one before; NULLs are alike."""
    return np.asarray(values[1:] != values[:-1], bool)


class _Part:
    """The storage rows of one part: versions as checkpoints and patches, and its edge."""

    def __init__(self, number: int, every: int):
        self.number, self.every = number, every
        self.canon: dict[str, str] = {}
        self.last = self.kept = self.edge = None
        self.seq = self.segment = self.in_segment = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows in order, one per moment."""
        if not batch.num_rows:
            return
        if len(self.canon) > 200_000:
            self.canon.clear()
        digests = []
        for v in batch.column("value").to_pylist():
            d = self.canon.get(v)
            if d is None:
                d = self.canon[v] = canonical_value(v)
            digests.append(d)
        columns = [_column(batch, "package_name"), _column(batch, "property_key"), np.array(digests, object)]
        here = [tuple(c[i] for c in columns) for i in (0, -1)]
        fresh = [np.concatenate([[self.last is None or self.last[i] != here[0][i]], _differs(c)]) for i, c in enumerate(columns)]
        self.last = here[1]
        starts = np.flatnonzero(fresh[0] | fresh[1] | fresh[2])
        entity = ~(fresh[0] | fresh[1])
        out = []
        for i, row in zip(starts, batch.take(pa.array(starts)).to_pylist()):
            now = {c: row[c] for c in ATTRIBUTES}
            self.seq += 1
            if not entity[i] or self.kept is None or self.in_segment >= self.every:
                self.segment, self.in_segment, kind, changed = self.segment + 1, 1, "checkpoint", list(ATTRIBUTES)
            else:
                self.in_segment, kind, changed = self.in_segment + 1, "patch", [c for c in ATTRIBUTES if now[c] != self.kept[c]]
            self.kept = now
            owner = {"package_name": row["package_name"], "property_key": row["property_key"]}
            if self.edge is None:
                self.edge = {**owner, "digest": digests[i], "observed_at": row["observed_at"], "last_changed": now["last_changed"], "changed": []}
            elif self.seq == 2 and all(self.edge[k] == v for k, v in owner.items()):
                self.edge |= {"changed": ["second"], "second_changed": now["last_changed"]}
            out.append({"part": self.number, "seq": self.seq, "row_kind": kind, "segment": self.segment, **owner, "digest": digests[i], "observed_at": row["observed_at"], "changed": changed, **{c: now[c] for c in changed}})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    def close(self) -> Iterator[pa.RecordBatch]:
        """The edge: the first version and the moment of its first row, and the last version."""
        if self.edge is not None:
            tail = dict(zip(("tail_package", "tail_property", "tail_digest"), self.last))
            yield pa.RecordBatch.from_pylist([{"part": self.number, "seq": 0, "row_kind": "edge", **self.edge, **tail}], schema=_SCHEMA)


def _compress(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 2 * TaskContext.get().partitionId()
        body, last = _Part(number, every), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*([last] if last is not None else []), batch]).combine_chunks().to_batches()[0]
            moved = np.logical_or.reduce([_differs(_column(rows, c)) for c in _MOMENT])
            yield from body.add(rows.slice(0, rows.num_rows - 1).filter(pa.array(moved, pa.bool_())))
            last = rows.slice(rows.num_rows - 1)
        yield from body.close()
        if last is not None:
            pending = _Part(number + 1, every)
            yield from pending.add(last)
            yield from pending.close()

    return run


def store(properties: DataFrame, checkpoint_every: int = 16, parts: int | None = None) -> DataFrame:
    """The checkpoint-delta storage of all properties, written into the shared folder.

    Rows: `checkpoint` (all attributes), `patch` (`changed` names the attributes that it sets) and one `edge` per part. Partition i
    writes part 2i and, for its last moment, part 2i+1. Of one moment of one property the highest obs_id holds (NULL is lowest; of rows with one obs_id the value of the highest digest).
    """
    spark = properties.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The bounds of ranges go to the driver, so they hold a digest of the value, however long it is.
    order = [*map(F.col, _MOMENT), F.col("obs_id"), F.xxhash64("value")]
    spread = observations(properties).repartitionByRange(n, *order).sortWithinPartitions(*order, "value")
    return stage_table(spread.mapInArrow(_compress(checkpoint_every), _STORE), "history")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def stitches(stored: DataFrame) -> DataFrame:
    """Per part of the storage: does its first version continue the one before (`merged`), and when does its last version end.

    Looks at the edge rows only, two per partition. next_from is a struct, NULL where no later version exists. A last moment that the
    next part goes on with has no row here: what it says does not hold.
    """
    edges = stored.where(F.col("row_kind") == "edge")
    line = Window.orderBy("part")
    edges = edges.withColumns({"after_" + c: F.lead(c).over(line) for c in _MOMENT} | {"has_after": F.lead("part").over(line).isNotNull()})
    edges = edges.where(~((F.col("part") % 2 == 1) & F.col("has_after") & _same("package_name", "after_package_name") & _same("property_key", "after_property_key") & _same("observed_at", "after_observed_at")))
    edges = edges.withColumns({"before_" + c: F.lag("tail_" + c).over(line) for c in ("package", "property", "digest")} | {"has_before": F.lag("part").over(line).isNotNull()})
    edges = edges.withColumn("merged", F.col("has_before") & _same("package_name", "before_package") & _same("property_key", "before_property") & _same("digest", "before_digest"))
    first = F.when(~F.col("merged"), F.struct(epoch_seconds(F.col("last_changed")).alias("at"))).when(
        F.array_contains("changed", "second"), F.struct(epoch_seconds(F.col("second_changed")).alias("at"))
    )
    heads = edges.select("part", "package_name", "property_key", first.alias("first_from"), F.lit(False).alias("tail"), "merged")
    tails = edges.select("part", F.col("tail_package").alias("package_name"), F.col("tail_property").alias("property_key"), F.lit(None).cast("struct<at:bigint>").alias("first_from"), F.lit(True).alias("tail"), "merged")
    later = Window.partitionBy("package_name", "property_key").orderBy("part").rangeBetween(1, Window.unboundedFollowing)
    both = heads.unionByName(tails).withColumn("next_from", F.first("first_from", ignorenulls=True).over(later))
    return both.where("tail").select(F.col("part").alias("edge_part"), "merged", "next_from", F.col("package_name").alias("tail_package"), F.col("property_key").alias("tail_property"))


def reconstruct(stored: DataFrame) -> DataFrame:
    """Every version with its attributes and period, from the storage.

    Columns: package_name, property_key, value, stable_for_n, first_seen, last_changed (as of the version's first row),
    valid_from, valid_to (whole epoch seconds; -1 while it lasts; NULL where the text of last_changed is unreadable).
    """
    segment = Window.partitionBy("part", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = stored.where(F.col("row_kind") != "edge").drop("tail_package", "tail_property", "tail_digest", "second_changed").repartition("part")
    folded = rows.withColumns({c: F.last(F.when(F.array_contains("changed", c), F.struct(c)), ignorenulls=True).over(segment)[c] for c in ATTRIBUTES})
    # At most two rows per partition of the storage, whose number the session fixes; parts without a row here are superseded.
    versions = folded.join(F.broadcast(stitches(stored)), F.col("part") == F.col("edge_part")).where(~((F.col("seq") == 1) & F.col("merged")))
    versions = versions.withColumn("valid_from", epoch_seconds(F.col("last_changed")))
    entity = Window.partitionBy("part", "package_name", "property_key").orderBy("seq")
    following = F.lead(F.struct(F.col("valid_from").alias("at"))).over(entity)
    at_tail = _same("package_name", "tail_package") & _same("property_key", "tail_property")
    until = F.coalesce(following, F.when(at_tail, F.col("next_from")))
    return versions.select("package_name", "property_key", *ATTRIBUTES, "valid_from", F.when(until.isNull(), F.lit(-1).cast("long")).otherwise(until["at"]).alias("valid_to"))


def attribute_history(properties: DataFrame, checkpoint_every: int = 16, parts: int | None = None) -> DataFrame:
    """Storage and reconstruction in one go.

    properties: package_name, property_key, obs_id, observed_at, value, stable_for_n, first_seen, last_changed; others are
    ignored. A NULL package or property is an entity of its own; a property seen once has one version that lasts; no rows
    give no versions.
    """
    return reconstruct(store(properties, checkpoint_every, parts))
