"""Has this key been seen before? Blocked Bloom filters, one chain per shard of the key space.

Keys travel as 128-bit digests. Rows are first reduced within each input batch: only the earliest row of a key is asked, the
others repeat it for sure, which takes a key with a third of all rows apart. Asked rows are hash-partitioned by shard, come in
order, and each chunk is queried, then inserted. A filter chain grows by levels, each with its own share of the target rate of
false positives, so nothing has to be counted beforehand and memory stays at some 30 bits per distinct key of one shard.
The filters decide which keys are in question: only those that they marked are checked, by their digests, and marks that no earlier
key explains are taken back. Known absent keys measure the filters' error.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.sources.work import stage_table

STATE, SEED, ASK, PROBE, REPEAT = -1, 0, 1, 2, 3  # what a row is, in the order in which a shard takes them
NEW, MARKED, SURE, PROBE_MISS, PROBE_HIT, KNOWN, FILTER = range(7)  # what becomes of it
_BLANK = ""


@lru_cache
def keys_per_block(rate: float) -> float:
    """Mean keys per 512-bit block (8 words, one bit in each) at which a block of Poisson load answers wrongly with that rate."""

    def wrong(mean: float) -> float:
        p, total = math.exp(-mean), 0.0
        for n in range(1, int(mean * 4 + 60)):
            p *= mean / n
            total += p * (1 - (63 / 64) ** n) ** 8
        return total

    low, high = 0.01, 64.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if wrong(mid) <= rate else (low, mid)
    return low


class BlockedFilter:
    """One level: blocks of eight 64-bit words; a key sets one bit in each word of one block."""

    def __init__(self, capacity: int, rate: float, words: np.ndarray | None = None, used: int = 0):
        self.capacity, self.used = capacity, used
        blocks = max(1, math.ceil(capacity / keys_per_block(rate)))
        self.words = np.zeros((blocks, 8), np.uint64) if words is None else words

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = ((h1 >> np.uint64(32)) * np.uint64(len(self.words)) >> np.uint64(32)).astype(np.int64)
        shifts = np.stack([(h2 >> np.uint64(6 * i)) & np.uint64(63) for i in range(8)], axis=1)
        return block, np.uint64(1) << shifts

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        block, bits = self._places(h1, h2)
        return ((self.words[block] & bits) == bits).all(axis=1)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        block, bits = self._places(h1, h2)
        np.bitwise_or.at(self.words, block, bits)
        self.used += len(h1)


class FilterChain:
    """Levels of four times the capacity of the one before and half its rate: together below the target rate at any size."""

    def __init__(self, rate: float, first: int = 4096):
        self.rate, self.first = rate, first
        self.levels: list[BlockedFilter] = []

    def _grow(self) -> None:
        i = len(self.levels)
        self.levels.append(BlockedFilter(self.first * 4**i, self.rate / 2 ** (i + 1)))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(h1), bool)
        for level in self.levels:
            hit |= level.has(h1, h2)
        return hit

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        while len(h1):
            if not self.levels or self.levels[-1].used >= self.levels[-1].capacity:
                self._grow()
            level = self.levels[-1]
            n = level.capacity - level.used
            level.add(h1[:n], h2[:n])
            h1, h2 = h1[n:], h2[n:]

    def query_then_insert(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """What becomes of each of the keys, in order: SURE where an earlier one of them is equal, else MARKED or NEW."""
        _, first, back = np.unique(h1, return_index=True, return_inverse=True)
        sure = (first[back] != np.arange(len(h1))) & (h2[first[back]] == h2)
        asked = np.flatnonzero(~sure)
        hit = self.has(h1[asked], h2[asked])
        fresh = asked[~hit]
        self.add(h1[fresh], h2[fresh])
        out = np.full(len(h1), SURE, np.int8)
        out[asked] = np.where(hit, MARKED, NEW)
        return out


_ROW = "shard int, kind tinyint, source tinyint, at timestamp_ntz, record_id long, h1 long, h2 long, bits binary"


def _numbers(column: pa.Array, kind: type) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)


def _reduce(shards: int):
    """Of each batch, only the earliest row of a key is asked; its shard is a part of its digest. Other rows are spread evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column("h1").is_valid(), batch.column("source").is_valid()))
            if not batch.num_rows:
                continue
            c = {n: batch.column(n) for n in batch.schema.names}
            kind, h1, ids = _numbers(c["kind"], np.int8), _numbers(c["h1"], np.int64), _numbers(c["record_id"], np.int64)
            h2 = _numbers(c["h2"], np.int64)
            at = c["at"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, at, kind, h2, h1))
            again = np.zeros(len(kind), bool)
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1]) & (kind[order][1:] == kind[order][:-1])
            again[order[1:]] = same
            keep = ~(again & (kind != ASK))
            repeat = again & (kind == ASK)
            kind = np.where(repeat, REPEAT, kind).astype(np.int8)
            spread = np.where(repeat, ids, h1 & 0x7FFFFFFF)
            none = pa.array(repeat)
            rows = {
                "shard": pa.array((np.abs(spread) % shards).astype(np.int32)), "kind": pa.array(kind), "source": c["source"], "at": c["at"], "record_id": c["record_id"],
                "h1": pc.if_else(none, 0, c["h1"]), "h2": pc.if_else(none, 0, c["h2"]), "bits": pa.nulls(len(kind), pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(rows).filter(pa.array(keep))

    return run


_MARK = "source tinyint, record_id long, at timestamp_ntz, h1 long, h2 long, verdict tinyint, shard int, bits binary"


def _filter(rate: float, keep_state: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, shard = FilterChain(rate), None

        def state() -> Iterator[pa.RecordBatch]:
            for i, level in enumerate(chain.levels if keep_state else []):
                meta = {"source": i, "record_id": level.used, "at": None, "h1": level.capacity, "h2": 0, "verdict": FILTER, "shard": shard, "bits": level.words.tobytes()}
                yield pa.RecordBatch.from_pylist([meta], schema=schema)

        schema = pa.schema([("source", pa.int8()), ("record_id", pa.int64()), ("at", pa.timestamp("us")), ("h1", pa.int64()), ("h2", pa.int64()), ("verdict", pa.int8()), ("shard", pa.int32()), ("bits", pa.binary())])
        for batch in batches:
            numbers = _numbers(batch.column("shard"), np.int32)
            for start in np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1)).tolist() if len(numbers) else []:
                stop = start + int(np.argmin(np.append(numbers[start:] == numbers[start], False)))
                if numbers[start] != shard:
                    if shard is not None:
                        yield from state()
                    chain, shard = FilterChain(rate), int(numbers[start])
                part = batch.slice(start, stop - start)
                kind = _numbers(part.column("kind"), np.int8)
                h1, h2 = (_numbers(part.column(n), np.int64).view(np.uint64) for n in ("h1", "h2"))
                verdict = np.full(len(kind), SURE, np.int8)
                for row in part.filter(pa.array(kind == STATE)).to_pylist():
                    words = np.frombuffer(row["bits"], np.uint64).reshape(-1, 8).copy()
                    chain.levels.append(BlockedFilter(row["h1"], rate, words, row["record_id"]))
                for k in (SEED, ASK, PROBE):
                    own = np.flatnonzero(kind == k)
                    if not len(own):
                        continue
                    if k == PROBE:
                        verdict[own] = np.where(chain.has(h1[own], h2[own]), PROBE_HIT, PROBE_MISS)
                    else:
                        got = chain.query_then_insert(h1[own], h2[own])
                        verdict[own] = got if k == ASK else KNOWN
                columns = [part.column(n) for n in ("source", "record_id", "at", "h1", "h2")]
                out = pa.RecordBatch.from_arrays([*columns, pa.array(verdict), part.column("shard"), pa.nulls(len(kind), pa.binary())], schema=schema)
                yield out.filter(pa.array(kind != STATE))
        if shard is not None:
            yield from state()

    return run


def digests(source: Column, key: Column) -> list[Column]:
    """Two 64-bit digests of a key within its source, independent of each other; h1 is NULL for NULL and empty keys."""
    return [F.when(key != _BLANK, F.xxhash64(source, key)).alias("h1"), F.xxhash64(F.lit("second"), key, source).alias("h2")]


def _rows(df: DataFrame, kind: int, sources: list[str], namespace: str = _BLANK) -> DataFrame:
    code = F.nullif(F.array_position(F.array(*(F.lit(s) for s in sources)), F.col("table_name")), F.lit(0).cast("long")) - 1
    # Blank keys get no digest and leave in the next step: a filter here would compute every key twice.
    return df.select(
        F.lit(kind).cast("tinyint").alias("kind"), code.cast("tinyint").alias("source"), F.col("at").cast("timestamp_ntz").alias("at"), F.col("record_id").cast("long").alias("record_id"),
        *digests(F.concat("table_name", F.lit(namespace)), F.col("key")),
    )


def marks(
    records: DataFrame, seeds: DataFrame, sources: list[str], rate: float = 1e-3, shards: int | None = None, state: DataFrame | None = None, probes: bool = False, keep_state: bool = False
) -> DataFrame:
    """What the filters say of every record, as a table in the shared folder.

    records: table_name, record_id, at, key; seeds: table_name, key. Keys that are NULL or empty and tables that are not among
    `sources` (at most 127) are left out; a NULL time is the earliest. state: the FILTER rows of an earlier call with the same
    rate and shards, whose keys count as seen. probes: ask each key again under a name that no record has, so known absent.
    """
    spark = records.sparkSession
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    nothing = seeds.withColumn("record_id", F.lit(None).cast("long")).withColumn("at", F.lit(None).cast("timestamp_ntz"))
    rows = _rows(records, ASK, sources).unionByName(_rows(nothing, SEED, sources))
    if probes:
        rows = rows.unionByName(_rows(records, PROBE, sources, "\0absent"))
    routed = rows.mapInArrow(_reduce(shards), _ROW)
    if state is not None:
        # A level's capacity and use travel in h1 and record_id; levels come back in their order by record time.
        old = state.where(F.col("verdict") == FILTER).select(
            "shard", F.lit(STATE).cast("tinyint").alias("kind"), "source", F.lit(None).cast("timestamp_ntz").alias("at"), "record_id", "h1", "h2", "bits"
        )
        routed = routed.unionByName(old)
    placed = routed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "at", F.when(F.col("kind") == STATE, F.col("source").cast("long")).otherwise(F.col("record_id")))
    return stage_table(placed.mapInArrow(_filter(rate, keep_state), _MARK), "marks")


def wrong_marks(marked: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """source and record_id of the rows that a filter marked although no earlier key is equal.

    Only keys with a row that filter bits marked are in question, and of each only the earliest such row: one digest per key. It is
    right if the key is among the seeds or has a row that was new, which is one row per key too, here or in `earlier`: the marks of all
    the calls whose state was carried in. All other rows, and every text, stay out of it.
    """
    first = F.min(F.struct("at", "record_id", "source"))
    keys = marked.where(F.col("verdict") == MARKED).groupBy("h1", "h2").agg(first.alias("first"))
    held = marked if earlier is None else marked.unionByName(earlier)
    explained = held.where(F.col("verdict").isin(NEW, KNOWN)).select("h1", "h2")
    return keys.join(explained, ["h1", "h2"], "left_anti").select("first.source", "first.record_id")


def _seen(marked: DataFrame, sources: list[str], earlier: DataFrame | None) -> DataFrame:
    seen = marked.where(F.col("verdict").isin(MARKED, SURE)).select("source", "record_id")
    right = seen.join(wrong_marks(marked, earlier), ["source", "record_id"], "left_anti")
    return right.select(F.element_at(F.array(*(F.lit(s) for s in sources)), F.col("source") + 1).alias("table_name"), "record_id")


def seen_records(records: DataFrame, seeds: DataFrame, sources: list[str], rate: float = 1e-3, shards: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """table_name and record_id of every record whose key is among the seeds or in an earlier record of its table.

    Earlier is by (at, record_id). Marks of the filters, less the wrong ones. Repeated rows of one record_id repeat each other.
    earlier: marks() of an earlier call with keep_state and the same rate and shards; its keys count as seen.
    """
    return _seen(marks(records, seeds, sources, rate, shards, earlier), sources, earlier)


def error_rates(records: DataFrame, seeds: DataFrame, sources: list[str], rate: float = 1e-3, shards: int | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Per table: records with a key, marks, wrong marks and their share of the new keys, and the share of absent keys marked. earlier: as for seen_records."""
    marked = marks(records, seeds, sources, rate, shards, earlier, probes=True)
    wrong = wrong_marks(marked, earlier).groupBy("source").agg(F.count(F.lit(1)).alias("n_wrong"))
    count = lambda *v: F.count(F.when(F.col("verdict").isin(*v), 1))
    rows = marked.groupBy("source").agg(
        count(NEW, MARKED, SURE).alias("n_records"), count(MARKED, SURE).alias("n_marked"), count(NEW).alias("n_new"), count(PROBE_HIT, PROBE_MISS).alias("n_absent"), count(PROBE_HIT).alias("n_absent_marked")
    )
    both = rows.join(wrong, "source", "left").withColumn("n_wrong", F.coalesce("n_wrong", F.lit(0).cast("long")))
    return both.select(
        F.element_at(F.array(*(F.lit(s) for s in sources)), F.col("source") + 1).alias("table_name"), "n_records", "n_marked", "n_wrong",
        F.try_divide(F.col("n_wrong"), F.col("n_wrong") + F.col("n_new")).alias("wrong_rate"), "n_absent", "n_absent_marked",
        F.try_divide("n_absent_marked", "n_absent").alias("absent_rate"), F.lit(rate).alias("target_rate"),
    )
