"""Bounded graph operators: edges, closures, exposure. Nodes keep their least distance only."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.sources.work import stage_table


def edges_of(rows: DataFrame, node: str, targets: str) -> DataFrame:
    """src, dst: each distinct pair of a node and a member of its array of targets, without loops and NULLs."""
    out = rows.select(F.col(node).alias("src"), F.explode(targets).alias("dst"))
    return out.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()


def in_degree(edges: DataFrame, least: int) -> DataFrame:
    """dst and n, the number of its sources, for those with at least `least`."""
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


#: A graph of more edges than this is not handed to single tasks as a whole.
_MOST_EDGES = 4_000_000
#: Targets in one row on their way from Python.
_TARGETS = 4096


def closure(edges: DataFrame, hops: int) -> DataFrame:
    """src, dst, distance: the least number of hops, up to `hops`, from each source to all it reaches. A source doesn't reach itself.

    The pairs may be the square of the nodes, so they are neither shuffled nor written in between. Blocks of sources each get the whole graph,
    number its nodes and spread 64 sources at once over it, one bit of a word each. What is shuffled is the edges times the blocks. A graph too large for
    one task is joined hop by hop instead.
    """
    edges = stage_table(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "edges")
    if edges.count() > _MOST_EDGES:
        return _joined(edges, hops)
    blocks = max(1, min(edges.select("src").distinct().count() // 256, 2 * edges.sparkSession.sparkContext.defaultParallelism))
    copies = edges.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartitionById(blocks, F.col("block"))
    found = copies.mapInArrow(_reach(hops, blocks), "src string, distance int, found array<string>")
    return found.select("src", F.explode("found").alias("dst"), "distance")


def _reach(hops: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over (src, dst, block): src, distance and up to some thousands of what it reaches first at that distance, for the sources of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, kept = set(), []
        for batch in batches:
            block = batch.column(2)
            own.update(pc.unique(block).to_pylist())
            kept.append(batch.filter(pc.equal(block, min(own))) if len(own) > 1 else batch)
        if not own:
            return
        # A partition with several blocks has the edges several times; those of its least block are all of them.
        table = pa.Table.from_batches(kept)
        table = table.filter(pc.equal(table.column(2), min(own)))
        m = table.num_rows
        coded = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        step = _step(codes[:m], codes[m:], len(names))
        # By name, as numbers differ between tasks.
        mine = [s for s in np.unique(codes[:m]) if zlib.crc32(names[int(s)].as_py().encode()) % blocks in own]
        rows: list[tuple[int, int, np.ndarray]] = []
        for i in range(0, len(mine), 64):
            for k, word in _levels(mine[i : i + 64], len(names), step, hops):
                some = np.flatnonzero(word)
                bits = word[some]
                for j, s in enumerate(mine[i : i + 64]):
                    found = some[(bits >> np.uint64(j)) & np.uint64(1) != 0]
                    rows += [(s, k, found[x : x + _TARGETS]) for x in range(0, len(found), _TARGETS)]
                    if sum(len(r[2]) for r in rows) >= 64 * _TARGETS:
                        yield _pairs(names, rows)
                        rows = []
        if rows:
            yield _pairs(names, rows)

    return run


def _step(a: np.ndarray, b: np.ndarray, nodes: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that moves the bits of all nodes' words over the edges from a to b."""
    order = np.argsort(b, kind="stable")
    a = a[order]
    targets, starts = np.unique(b[order], return_index=True)

    def step(word: np.ndarray) -> np.ndarray:
        new = np.zeros(nodes, np.uint64)
        if len(a):
            new[targets] = np.bitwise_or.reduceat(word[a], starts)
        return new

    return step


def _levels(sources: list[int], nodes: int, step: Callable[[np.ndarray], np.ndarray], hops: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each distance with a word for each node; bit j says that the j-th of up to 64 sources first reaches the node at that distance."""
    word = np.zeros(nodes, np.uint64)
    for j, s in enumerate(sources):
        word[s] |= np.uint64(1 << j)
    seen = word.copy()
    for k in range(1, hops + 1):
        word = step(word) & ~seen
        seen |= word
        yield k, word


def _pairs(names: pa.Array, rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(r[2]) for r in rows)])
    found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(np.concatenate([r[2] for r in rows]))))
    return pa.RecordBatch.from_arrays([names.take(pa.array([int(r[0]) for r in rows])), pa.array([r[1] for r in rows], pa.int32()), found], names=["src", "distance", "found"])


def _joined(edges: DataFrame, hops: int) -> DataFrame:
    """The closure by joins. Each round joins only the pairs that the last round found first, and its result is written before the next."""
    reached = edges.select("src", "dst", F.lit(1).alias("distance"))
    front = reached
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for k in range(2, hops + 1):
        found = front.join(step, "dst").where(F.col("src") != F.col("next")).select("src", F.col("next").alias("dst")).distinct()
        front = stage_table(found.join(reached, ["src", "dst"], "left_anti").withColumn("distance", F.lit(k)), "hops")
        reached = reached.unionByName(front)
    return reached


def _ranked(lists: DataFrame) -> DataFrame:
    """node, member, and the place (from 1) of each member among its node's, by name."""
    return lists.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("member")))


def _firsts(wanted: DataFrame, edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """node, member: of each target of a wanted node (node, k) the first k members. Each row that comes out is one that was asked for by its place."""
    sizes = ranked.groupBy(F.col("node").alias("dst")).agg(F.max("place").alias("size"))
    asked = wanted.join(edges.select(F.col("src").alias("node"), "dst"), "node").join(sizes, "dst")
    asked = asked.select("node", "dst", F.explode(F.expr("sequence(1, cast(least(k, size) as int))")).alias("place"))
    return asked.join(ranked.select(F.col("node").alias("dst"), "member", "place"), ["dst", "place"]).select("node", "member").distinct()


def _asked(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """node, k: the targets of wanted nodes (node, k), each with the most that one of these wants. Written, as are lists, for each is read several times."""
    return stage_table(wanted.join(edges.select(F.col("src").alias("node"), "dst"), "node").groupBy(F.col("dst").alias("node")).agg(F.max("k").alias("k")), "asked")


def _lists(wanted: DataFrame, edges: DataFrame, direct: DataFrame, steps: int) -> DataFrame:
    """node, member, place: the first k marked nodes that each wanted node (node, k) reaches by a path of so many steps, two at least. direct has those of one step."""
    ranked = _ranked(_firsts(wanted, edges, _lists(_asked(wanted, edges), edges, direct, steps - 1) if steps > 2 else direct))
    return stage_table(ranked.join(wanted, "node").where("place <= k").select("node", "member", "place"), "lists")


def _walked(starts: DataFrame, edges: DataFrame, ends: DataFrame, steps: int) -> DataFrame:
    """src, dst: each start (column `node`) and each end (column `node`) to which a path of so many steps leads."""
    front = edges.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    for k in range(2, steps + 1):
        step = edges.join(ends.select(F.col("node").alias("dst")), "dst", "left_semi") if k == steps else edges
        front = front.join(step.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")).distinct()
    return front


def _searched(sources: DataFrame, count: int, edges: DataFrame, marks: DataFrame, hops: int, least: int) -> DataFrame:
    """src, via, distance of those of so many sources (column `node`) that are exposed to a marked node (column `node`).

    As for closure(), blocks of sources each get the whole graph; a task keeps only the first marked node of each of its sources.
    """
    blocks = max(1, min(count // 256, 2 * edges.sparkSession.sparkContext.defaultParallelism))
    none = F.lit(None).cast("string")
    # A marked node is a row without dst, a source one without src in its own block.
    graph = edges.select("src", "dst").unionByName(marks.select(F.col("node").alias("src"), none.alias("dst")))
    graph = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = sources.select(none.alias("src"), F.col("node").alias("dst"), F.pmod(F.hash("node"), F.lit(blocks)).alias("block"))
    return graph.unionByName(own).repartitionById(blocks, F.col("block")).mapInArrow(_nearest(hops, least), "src string, via string, distance int")


def _nearest(hops: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow over the rows of _searched: src, via, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, kept, sources = None, [], []
        for batch in batches:
            start, block = batch.column(0), batch.column(2)
            sources.append(batch.column(1).filter(pc.is_null(start)))
            # As in _reach: the graph comes once for each block of the partition, the least block's is kept.
            rest, block = batch.filter(pc.is_valid(start)), block.filter(pc.is_valid(start))
            if rest.num_rows:
                first = min(first, pc.min(block).as_py()) if first is not None else pc.min(block).as_py()
                kept.append(rest.filter(pc.equal(block, first)))
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        table = table.filter(pc.equal(table.column(2), first))
        edge = pc.is_valid(table.column(1))
        edges, marks = table.filter(edge), table.filter(pc.invert(edge)).column(0)
        # Marked nodes are numbered first and by name, so that the least number is the first name.
        marks = marks.take(pc.sort_indices(marks))
        coded = pa.chunked_array([*marks.chunks, *sources, *edges.column(0).chunks, *edges.column(1).chunks], pa.string()).combine_chunks().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        n, m = len(marks), edges.num_rows
        mine = codes[n : len(codes) - 2 * m]
        step = _step(codes[len(codes) - 2 * m : len(codes) - m], codes[len(codes) - m :], len(names))
        for i in range(0, len(mine), 64):
            part, found = mine[i : i + 64], []
            open_ = np.uint64((1 << len(part)) - 1)
            for k, word in _levels(part, len(names), step, hops):
                if k < least:
                    continue
                reached = np.flatnonzero(word[:n] & open_)
                words = word[reached]
                for j in np.flatnonzero((np.bitwise_or.reduce(words) & open_) >> np.arange(64, dtype=np.uint64) & np.uint64(1)):
                    found.append((int(part[j]), int(reached[np.argmax(words >> np.uint64(j) & np.uint64(1))]), k))
                    open_ &= ~np.uint64(1 << int(j))
                if not open_:
                    break
            if found:
                s, via, k = zip(*found)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(s)), names.take(pa.array(via)), pa.array(k, pa.int32())], names=["src", "via", "distance"])

    return run


#: Sources with more nearer marked nodes than this are searched from: what they ask for would make long lists for all nodes on their way.
_FEW = 8


def exposure(edges: DataFrame, marked: DataFrame, hops: int, least: int = 2) -> DataFrame:
    """src, via, distance: of each source the nearest marked node (column `node`) at least `least` hops away, the first by name among equals.

    No closure: a source with x marked nodes nearer than `least` (itself among them) needs of each target's sorted marked nodes
    only the first x+1, of which one at least is new if any is. A source that finds one is done; for the others the same x stay excluded.
    Beyond two hops such lists are passed on from node to node. Only sources of small x ask so, which bounds what is shuffled by some rows an edge.
    From the others, as many as they may be, the graph is searched within tasks; a graph too large for one task lets them find the last node but one first.
    """
    edges = stage_table(edges.select("src", "dst"), "edges")
    marks = marked.where("node IS NOT NULL").select(F.col("node").alias("dst")).distinct()
    lists = edges.join(marks, "dst", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("member")).distinct()
    direct = stage_table(_ranked(lists), "marked")
    lists = direct.select("node", "member")
    near = edges.select("src").distinct().select(F.col("src").alias("node"), F.col("src").alias("member"))
    for k in range(1, least):
        lists = lists if k == 1 else edges.select(F.col("src").alias("node"), "dst").join(lists.select(F.col("node").alias("dst"), "member"), "dst").select("node", "member").distinct()
        near = near.unionByName(lists)
    near = stage_table(near.distinct(), "near") if least > 1 else near
    open_ = stage_table(near.groupBy("node").agg((F.count(F.lit(1)) + 1).alias("k")), "open")
    out = near.where(F.lit(False)).select(F.col("node").alias("src"), F.col("member").alias("via"), F.lit(0).alias("distance"))
    many = open_.where(F.col("k") > _FEW)
    count = many.count()
    large = edges.count() > _MOST_EDGES
    if count and not large:
        out = out.unionByName(_searched(many, count, edges, direct.select(F.col("member").alias("node")).distinct(), hops, least))
        open_ = open_.where(F.col("k") <= _FEW)
    for k in range(least, hops + 1):
        if k == 1:
            found = direct.select("node", "member")
        elif k == 2:
            found = _firsts(open_, edges, direct)
        else:
            few = open_.where(F.col("k") <= _FEW)
            found = _firsts(few, edges, _lists(_asked(few, edges), edges, direct, k - 1))
            if count and large:
                many = open_.where(F.col("k") > _FEW)
                found = found.unionByName(_firsts(many, _walked(many, edges, direct.select("node").distinct(), k - 1), direct))
        best = found.join(near, ["node", "member"], "left_anti").groupBy("node").agg(F.min("member").alias("via"))
        best = stage_table(best.join(open_.select("node"), "node", "left_semi").select(F.col("node").alias("src"), "via", F.lit(k).alias("distance")), "exposed")
        out = out.unionByName(best)
        open_ = stage_table(open_.join(best.select(F.col("src").alias("node")), "node", "left_anti"), "open") if k < hops else open_
    return out


def walk(edges: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """node, level, parent: all that the roots (column `node`) depend on, breadth first, each node once at its least level.

    parent is the first by name of the nodes a level above that lead to it, NULL for roots.
    """
    front = roots.select("node").distinct().select("node", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent"))
    seen = front
    for k in range(1, levels + 1):
        found = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        front = stage_table(found.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).alias("level"), "parent"), "level")
        seen = seen.unionByName(front)
    return seen


def chain_order(commits: DataFrame, sha: str, parent: str) -> DataFrame:
    """commits with `place`: how many ancestors each has along its parents, so that parents come before children.

    By pointer doubling: every round each row jumps twice as far, so a chain of n commits takes log2(n) joins. A parent that is not
    among the commits, or NULL, ends a chain; rows of a cycle have NULL.
    """
    known = commits.select(F.col(sha).alias("s"), F.col(parent).alias("p")).where("s IS NOT NULL").dropDuplicates(["s"])
    there = known.select(F.col("s").alias("p"), F.lit(True).alias("known"))
    rows = stage_table(known.join(there, "p", "left").select("s", F.when(F.col("known"), F.col("p")).alias("jump"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("place")), "chain")
    longest = rows.count()
    reach = 1
    while reach <= longest and rows.where("jump IS NOT NULL").limit(1).count():
        ahead = rows.select(F.col("s").alias("jump"), F.col("jump").alias("further"), F.col("place").alias("more"))
        rows = stage_table(rows.join(ahead, "jump", "left").select("s", F.col("further").alias("jump"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "chain")
        reach *= 2
    return commits.join(rows.select(F.col("s").alias(sha), F.when(F.col("jump").isNull(), F.col("place")).alias("place")), sha, "left")
