"""Mixing sources to target weights by min-cost flow over membership patterns.

Sources overlap: one text can stand in several of them. Texts are aggregated by membership pattern (the set of target sources
that hold them); a min-cost flow routes each pattern's tokens to the sources' quotas, where every further repetition of the
same tokens costs more than the one before. The flow fixes, per pattern, how far along a seeded order of its texts each
source draws, and documents are selected by their place in that order.
"""

import math
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.text import name_key
from auditloom.llm.byte_pairs import VOCABULARY, WordEncoder, load_merges
from auditloom.sources.work import slices, spread, stage_table


class Flow:
    """A network with integer capacities and costs; shortest augmenting paths."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(k)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        """Push as much as fits at the least cost; the amount."""
        pushed = 0
        while True:
            far = [math.inf] * len(self.out)
            via = [-1] * len(self.out)
            far[source], queue, waiting = 0, deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.left[e] and far[a] + self.cost[e] < far[b]:
                        far[b], via[b] = far[a] + self.cost[e], e
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
            if via[sink] < 0:
                return pushed
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            amount = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= amount
                self.left[e ^ 1] += amount
            pushed += amount


class Target(NamedTuple):
    source: str
    weight: float
    repeats: int


class Draw(NamedTuple):
    """What a pattern gives: its members, tokens and cap, and the tokens routed to each member."""

    members: tuple[str, ...]
    tokens: int
    cap: int
    routed: dict[str, int]


def repetitions(cap: int) -> list[tuple[int, int]]:
    """(cost, times): what the repetitions up to the cap cost, each of the first 16 more than the one before, then groups that double.

    >>> repetitions(3), sum(times for _, times in repetitions(1000)), len(repetitions(10**9)) < 70
    ([(0, 1), (1, 1), (2, 1)], 1000, True)
    """
    out, at = [], 0
    while at < cap:
        times = min(cap - at, max(1, at // 16 * 8))
        out.append((at, times))
        at += times
    return out


def _route(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, Target], quotas: dict[str, int]) -> tuple[int, list[Draw]]:
    names = list(quotas)
    flow = Flow(2 + len(patterns) + len(names))
    first = 2 + len(patterns)
    arcs = []
    for i, (members, tokens) in enumerate(patterns):
        cap = min(targets[s].repeats for s in members)
        for again, times in repetitions(cap):
            flow.add(0, 2 + i, tokens * times, again)
        arcs.append((cap, {s: flow.add(2 + i, first + names.index(s), tokens * cap) for s in members if s in quotas}))
    for j, s in enumerate(names):
        flow.add(first + j, 1, quotas[s])
    pushed = flow.run(0, 1)
    return pushed, [Draw(m, t, cap, {s: flow.left[e ^ 1] for s, e in own.items()}) for (m, t), (cap, own) in zip(patterns, arcs)]


def plan_mix(patterns: list[tuple[tuple[str, ...], int]], targets: list[Target], total: int | None = None) -> tuple[dict[str, int], list[Draw]]:
    """Quota per source, and what each pattern gives.

    Weights are shared out among the targets with a weight and a cap above 0 that any pattern with tokens holds. total: tokens of
    the mix; None means the largest at which every source still meets its share within the caps. A text of several sources
    occurs at most as often as the strictest of them allows. Beyond what is there, quotas stay unfilled rather than a cap broken.
    """
    by_name = {t.source: t for t in targets if t.repeats > 0 and t.weight > 0}
    merged: dict[tuple[str, ...], int] = {}
    for members, n in patterns:
        own = tuple(s for s in members if s in by_name)
        if own and n > 0:
            merged[own] = merged.get(own, 0) + n
    able = sorted(merged.items())
    held = {s for m, _ in able for s in m}
    weights = {s: t.weight for s, t in by_name.items() if s in held}
    whole = sum(weights.values())
    if not weights:
        return {}, []
    share = {s: w / whole for s, w in weights.items()}
    quotas = lambda n: {s: math.floor(n * w) for s, w in share.items()}
    if total is None:
        low, high = 0, sum(n * min(by_name[s].repeats for s in m) for m, n in able)
        while low < high:
            mid = (low + high + 1) // 2
            q = quotas(mid)
            low, high = (mid, high) if _route(able, by_name, q)[0] == sum(q.values()) else (low, mid - 1)
        total = low
    own = quotas(total)
    return own, _route(able, by_name, own)[1]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with n_tokens, the number of the text's tokens; its last column `text` is dropped."""
    merges = docs.sparkSession.sparkContext.broadcast(load_merges(vocabulary))
    names = [c for c in docs.columns if c != "text"]
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for a, b in slices(batch.column(place), 4_000_000):
                encoder = encoder or WordEncoder(merges.value)
                part = batch.slice(a, b - a)
                counts = [len(x) for x in encoder.encode(part.column(place).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if i != place), pa.array(counts, pa.int64())], names=[*names, "n_tokens"])

    return spread(docs).mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField("n_tokens", T.LongType())]))


def distinct_texts(docs: DataFrame, targets: list[Target], vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per distinct text that a target source holds: doc_id (the least), members (sorted), n_tokens, h1, h2; in the shared folder."""
    known = F.array(*(F.lit(t.source) for t in targets)) if targets else F.array().cast("array<string>")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name_key(F.col("source")).alias("source"), F.col("text").cast("string").alias("text"))
    keyed = keyed.where(F.array_contains(known, F.col("source")) & (F.length("text") > 0))
    sized = token_counts(keyed.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), F.col("text")).alias("h2"), "text"), vocabulary)
    texts = sized.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("members"), F.max("n_tokens").alias("n_tokens"))
    return stage_table(texts, "texts")


def read_targets(targets: DataFrame) -> list[Target]:
    """The targets, names trimmed and in lower case: a small table with one row per source, which is part of the query."""
    rows = targets.select(name_key(F.col("source")).alias("source"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r"))
    rows = rows.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("w").alias("w"), F.min("r").alias("r")).orderBy("source")
    return [Target(r.source, r.w or 0.0, r.r if r.r is not None else 1) for r in rows.collect()]


def _placed(texts: DataFrame, seed: int, bucket_rows: int = 20_000) -> DataFrame:
    """The texts with `start`, the tokens before each in the seeded order of its pattern: sums per bucket of that order, then within."""
    bits = max(0, min(20, math.ceil(math.log2(max(1, texts.count()) / bucket_rows))))
    order = F.xxhash64(F.lit(seed), "h1", "h2")
    bucket = F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long")
    rows = texts.withColumns({"order_": order, "bucket": bucket})
    sums = rows.groupBy("members", "bucket").agg(F.sum("n_tokens").alias("n"))
    # At most 2^20 rows per pattern, whatever the data.
    sums = sums.withColumn("base", F.sum("n").over(Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    inner = Window.partitionBy("members", "bucket").orderBy("order_", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("own", F.sum("n_tokens").over(inner) - F.col("n_tokens")).join(sums, ["members", "bucket"]).withColumn("start", F.col("base") + F.col("own"))


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 7, total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mix: one row per occurrence of a text.

    docs: doc_id, text, source; targets: source, target_weight, max_repeats. Result: doc_id, mix_source (for which it is drawn),
    copy_no (from 1), n_tokens. Equal texts are one text, under the least doc_id, that belongs to all their sources, so posting a
    text twice doesn't get it past max_repeats. NULL and empty texts, NULL sources and sources without a target have no part. A text
    is in or out as a whole, so a source misses its quota by about one text per pattern. Targets that occur twice add up their
    weights under the stricter cap. Without targets or texts the mix is empty.
    """
    wanted = read_targets(targets)
    texts = distinct_texts(docs, wanted, vocabulary)
    return _selected(texts, wanted, seed, total)[0]


def _patterns(texts: DataFrame, most: int = 65_536) -> list[tuple[tuple[str, ...], int]]:
    """Tokens by membership pattern. They go to the driver, so more than `most` of them are an error: fewer than 2 to the number of target sources."""
    rows = texts.groupBy("members").agg(F.sum("n_tokens").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} combinations of sources: mix fewer sources at once")
    return sorted((tuple(r.members), r.n) for r in rows)


def _selected(texts: DataFrame, wanted: list[Target], seed: int, total: int | None) -> tuple[DataFrame, dict[str, int]]:
    spark = texts.sparkSession
    quotas, draws = plan_mix(_patterns(texts), wanted, total)
    rows = []
    for d in draws:
        ends, at = [], 0
        for s in sorted(d.routed):
            at += d.routed[s]
            ends.append((at, s))
        if at:
            rows.append((list(d.members), d.tokens, d.cap, ends))
    plan = spark.createDataFrame(rows, "able array<string>, tokens long, cap int, ends array<struct<until:bigint,mix_source:string>>")
    able = F.filter("members", lambda s: s.isin(list(quotas)) if quotas else F.lit(False))
    spread = _placed(texts.withColumn("members", able).where(F.size("members") > 0), seed).join(plan, F.col("members") == F.col("able"))
    # A copy is drawn if its middle lies before the end of what is routed, so only as many copies are made as are drawn.
    end = F.element_at("ends", -1)["until"]
    n = F.least(F.col("cap"), F.ceil((end - F.col("start") - F.col("n_tokens") / 2) / F.col("tokens")))
    copies = spread.withColumn("n", n).where("n > 0").select("doc_id", "n_tokens", "start", "tokens", "ends", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
    middle = F.col("copy") * F.col("tokens") + F.col("start") + F.col("n_tokens") / 2
    drawn = copies.withColumn("to", F.filter("ends", lambda e: middle < e["until"]))
    return drawn.select("doc_id", F.col("to")[0]["mix_source"].alias("mix_source"), (F.col("copy") + 1).cast("int").alias("copy_no"), "n_tokens"), quotas


def mix_shares(docs: DataFrame, targets: DataFrame, seed: int = 7, total: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per target source: weight, cap, texts and tokens there, quota, tokens drawn, the share that they are of the mix, and the most copies of one text.

    effective_share is the share that the quotas aim at: targets without documents, weight or cap give theirs up to the others.
    """
    wanted = read_targets(targets)
    texts = distinct_texts(docs, wanted, vocabulary)
    chosen, quotas = _selected(texts, wanted, seed, total)
    there = texts.select(F.explode("members").alias("source"), "n_tokens").groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_tokens").alias("tokens_there"))
    drawn = chosen.groupBy(F.col("mix_source").alias("source")).agg(F.count(F.lit(1)).alias("n_drawn"), F.sum("n_tokens").alias("tokens_drawn"), F.max("copy_no").alias("most_copies"))
    whole = sum(t.weight for t in wanted if t.source in quotas)
    named = docs.sparkSession.createDataFrame(
        [(t.source, t.weight, t.repeats, t.weight / whole if t.source in quotas else 0.0, quotas.get(t.source, 0)) for t in wanted],
        "source string, target_weight double, max_repeats int, effective_share double, quota long",
    )
    counts = ["n_texts", "tokens_there", "n_drawn", "tokens_drawn", "most_copies"]
    both = named.join(there, "source", "left").join(drawn, "source", "left").fillna(0, counts)
    # A window over one row per target.
    return both.withColumn("actual_share", F.try_divide("tokens_drawn", F.sum("tokens_drawn").over(Window.partitionBy())))
