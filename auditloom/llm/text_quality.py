"""Text quality statistics, and a Gaussian mixture over them that tells natural prose from lists, tables and junk.

A document is cut into blocks (runs of lines without a blank line between). Each block gets its statistics; a mixture is
fitted to the standardized statistics of all blocks by expectation-maximization, one pass over the data per round, of which
only sums come back. Each component takes the class (prose, list, table, junk) of the inspected examples that it claims. A
document is natural prose if most of its non-blank characters lie in blocks that are more likely prose than not.
"""

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.text import trimmed
from auditloom.llm.quality_examples import EXAMPLES
from auditloom.sources.work import slices, spread, stage_table

CLASSES = ("prose", "list", "table", "junk")
STATISTICS = (
    "common_share", "word_share", "word_length", "symbol_share", "digit_share", "marker_share", "ended_share", "line_words", "sentence_words", "fresh_share", "vowel_share",
    "indent_share", "frame_share", "odd_share", "name_share", "run_share",
)

_BLOCKS = regex.compile(r"\n(?:[^\S\n]*\n)+")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")
_PLAIN = regex.compile(r"[\p{Ps}\p{Pi}\"'¿¡]*[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*['’]?[\p{Pe}\p{Pf}\"']*[.,;:!?…]*[\p{Pe}\p{Pf}\"']*")
_NAME = regex.compile(r"\p{Ll}[\p{Ll}\d]*(?:[-_.+]\p{Ll}[\p{Ll}\d]*)*(?:[<>=]+[\d.:\-]+)?[,;]?")
_MARKER = regex.compile(r"\s*(?:[-*•–—+·◦▪‣]\s|\(?(?:\d{1,3}|[a-zA-Z])[.)\]]\s|\[[\dxX ]*\]\s|\p{L}+ \d+:\s)")
_QUOTE = regex.compile(r"^(?:\s*>)+ ?", regex.M)
_ENDED = regex.compile(r"[.!?…][\p{Pe}\p{Pf}\"'’]*\s*$")
_CLOSERS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Pe", "Pf")) + "\"'’"
_ENDS = tuple(".!?…")
_SENTENCE_END = regex.compile(r"[.!?…]+[\p{Pe}\p{Pf}\"']*(?=\s|$)")
_VOWELS = regex.compile(r"[aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüýÿ]", regex.I)
_FRAME = regex.compile(r"[=(){}\[\]|<>\"\t$@/\\_;─-╿]")
_ODD = regex.compile(r"[^\p{L}\p{M}\p{N}\p{P}\p{Zs}\p{Cf}\s$+<=>^`|~]|�|[%#&*~^\\]")
_RUN = regex.compile(r"(\S{1,3}?)\1{3,}")
_HIDDEN = regex.compile(r"[\u00AD\u200B-\u200F\u2060-\u2064\uFEFF]")


def blocks(text: str) -> list[str]:
    """The text's blocks, in order, without empty ones. A text with blank lines between all its lines, four or more, is one block."""
    own = [b for b in _BLOCKS.split(text.strip().replace("\r\n", "\n").replace("\r", "\n")) if b.strip()]
    spaced = len(own) >= 4 and not any("\n" in b.strip() for b in own)
    return ["\n".join(own)] if spaced else own


def filled(text: str) -> int:
    """Characters that aren't white space."""
    return sum(map(len, text.split()))


class _Kinds(dict):
    """What a character is, as six counters side by side in one number, so that a sum over characters counts all at once."""

    WIDE = 40

    def __missing__(self, c: str) -> int:
        letter = c.isalpha()
        flags = (not c.isalnum(), c.isdigit(), letter, letter and _VOWELS.match(c) is not None, _FRAME.match(c) is not None, _ODD.match(c) is not None)
        self[c] = sum(bool(f) << self.WIDE * i for i, f in enumerate(flags))
        return self[c]


_KINDS = _Kinds()


class TokenTable:
    """What each token adds to a block's sums, worked out once per token and task; forgotten when it has met `room` tokens.

    Columns: characters, symbols, digits, letters, vowels, frame signs, odd signs, is plain, is a rare name, words, letters of words, common
    words, ends a sentence, characters in runs.
    """

    def __init__(self, common: frozenset[str], room: int = 100_000):
        self.common, self.room = common, room
        self.at: dict[str, int] = {}
        self.sums = np.zeros((1024, 14))

    def _row(self, t: str) -> tuple[int, ...]:
        packed = sum(map(_KINDS.__getitem__, t))
        symbols, digits, letters, vowels, frames, odd = ((packed >> _Kinds.WIDE * i) & ((1 << _Kinds.WIDE) - 1) for i in range(6))
        low = t.lower()
        words = [low] if letters == len(t) else [w.lower() for w in _WORD.findall(t)]
        rare = len(t) > 2 and low.strip(",;.") not in self.common and _NAME.fullmatch(t) is not None
        runs = sum(x.end() - x.start() for x in _RUN.finditer(t)) if len(t) > 3 else 0
        return (
            len(t), symbols, digits, letters, vowels, frames, odd, letters == len(t) or _PLAIN.fullmatch(t) is not None, rare, len(words), sum(map(len, words)), sum(map(self.common.__contains__, words)),
            symbols > 0 and _ENDED.search(t) is not None, runs,
        )

    def total(self, counts: Counter) -> np.ndarray:
        """The sums over tokens with their counts."""
        if len(self.at) + len(counts) > max(self.room, len(counts)):
            self.at.clear()
        for t in counts:
            if t not in self.at:
                n = len(self.at)
                if n == len(self.sums):
                    self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.sums[n] = self._row(t)
                self.at[t] = n
        return np.fromiter(counts.values(), float, len(counts)) @ self.sums[[self.at[t] for t in counts]]


@lru_cache(4)
def _table(common: frozenset[str]) -> TokenTable:
    return TokenTable(common)


def _freshness(tokens: list[str], window: int = 64) -> float:
    """The logarithm of the share of distinct words, on average over windows: long texts are not less fresh than short ones."""
    parts = [tokens[i : i + window] for i in range(0, len(tokens), window)]
    return sum(len(p) * math.log(len(set(p)) / len(p)) for p in parts) / max(1, len(tokens))


def statistics(block: str, common: frozenset[str]) -> list[float]:
    """The statistics of a block, as named by STATISTICS. All are shares from 0 to 1 but for lengths and the share of fresh words, which are logarithms.

    Quote marks at line starts and invisible characters don't count.
    """
    text = block if block.isascii() else _HIDDEN.sub("", block)
    text = _QUOTE.sub("", text) if ">" in text else text
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    tokens = text.split()
    n_lines, n_tokens = len(lines), max(1, len(tokens))
    size, symbols, digits, letters, vowels, frames, odd, plain, names, words, word_letters, known, ends, runs = _table(common).total(Counter(tokens)).tolist() if tokens else [0.0] * 14
    n, m = max(1, words), max(1, size)
    return [
        known / n,
        plain / n_tokens,
        math.log1p(word_letters / n),
        symbols / m,
        digits / m,
        sum(_MARKER.match(x) is not None for x in lines) / n_lines,
        sum(x.rstrip().rstrip(_CLOSERS).endswith(_ENDS) for x in lines) / n_lines,
        math.log1p(words / n_lines),
        math.log1p(words / max(1, ends)),
        _freshness(tokens),
        vowels / max(1, letters),
        sum(x[:1] in " \t" for x in lines) / n_lines,
        frames / m,
        odd / m,
        names / n_tokens,
        min(1.0, runs / m),
    ]


class Mixture:
    """A Gaussian mixture over standardized statistics."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.weights, self.means, self.covariances = weights, means, covariances
        self.factors = np.linalg.inv(np.linalg.cholesky(covariances))
        self.constants = np.log(weights) + np.log(np.abs(np.diagonal(self.factors, axis1=1, axis2=2))).sum(axis=1)
        # All components' whitening side by side: one product for a batch of rows.
        self.stacked = self.factors.reshape(-1, means.shape[1]).T.copy()
        self.shifts = np.einsum("kij,kj->ki", self.factors, means).ravel()

    def weighed(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, the probability that it comes from each component, and the logarithm of its density (less a constant)."""
        k, d = self.means.shape
        white = z @ self.stacked
        white -= self.shifts
        white *= white
        logs = self.constants - 0.5 * white.reshape(-1, k, d).sum(axis=2)
        top = logs.max(axis=1, keepdims=True)
        p = np.exp(logs - top)
        whole = p.sum(axis=1, keepdims=True)
        return p / whole, (top + np.log(whole)).ravel()

    def shares(self, z: np.ndarray) -> np.ndarray:
        return self.weighed(z)[0]

    def sums(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        """Per component the count, the sum and the sum of outer products of its part of the rows, in one vector each; the rows' log-likelihood."""
        p, density = self.weighed(z)
        products = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
        return np.concatenate([p.sum(axis=0)[:, None], p.T @ z, p.T @ products], axis=1), float(density.sum())

    @staticmethod
    def of(sums: np.ndarray, d: int, floor: float, prior: "Mixture") -> "Mixture":
        """The mixture of largest likelihood for the sums; a component that lost all its rows stays as it was."""
        n = sums[:, 0]
        alive = n > 1e-6
        safe = np.where(alive, n, 1.0)
        means = np.where(alive[:, None], sums[:, 1 : d + 1] / safe[:, None], prior.means)
        seconds = sums[:, d + 1 :].reshape(-1, d, d) / safe[:, None, None] - means[:, :, None] * means[:, None, :]
        # The prior of `floor` rows with that variance keeps a component from shrinking to a point.
        spread = (seconds * safe[:, None, None] + np.eye(d) * 25 * floor) / (safe + 25)[:, None, None] + np.eye(d) * floor
        covariances = np.where(alive[:, None, None], spread, prior.covariances)
        weights = np.maximum(n, 1e-3)
        return Mixture(weights / weights.sum(), means, covariances)


_SUMS = "slot int, sums binary"


def _total(df: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of sums(rows) over all rows of statistics, added up in two levels; None if there are no rows.

    Each task adds up its own rows, about the square root of the tasks add those up, and the driver the rest: it sees that many
    rows of fixed size.
    """
    width = len(STATISTICS)
    slots = max(1, math.isqrt(df.rdd.getNumPartitions()))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, total = TaskContext.get().partitionId() % slots, None
        for batch in batches:
            z = np.asarray(batch.column("stats").flatten()).reshape(-1, width)
            for i in range(0, len(z), 1024):
                part = sums(z[i : i + 1024])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "sums": [total.tobytes()]})

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(b) for batch in batches for b in batch.column("sums").to_pylist()]
        if own:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([0], pa.int32()), "sums": [np.sum(own, axis=0).tobytes()]})

    rows = df.select("stats").mapInArrow(first, _SUMS).repartition(slots, "slot").mapInArrow(second, _SUMS).collect()
    return np.sum([np.frombuffer(r.sums) for r in rows], axis=0) if rows else None


def start(examples: np.ndarray, families: list[str]) -> Mixture:
    """One component per family of examples, at its mean, all of the same width."""
    names = list(dict.fromkeys(families))
    means = np.array([examples[[f == n for f in families]].mean(axis=0) for n in names])
    k, d = means.shape
    return Mixture(np.full(k, 1 / k), means, np.repeat(np.eye(d)[None] * 0.3, k, axis=0))


def classes_of(mixture: Mixture, examples: np.ndarray, classes: list[str]) -> list[str]:
    """The class of each component: that of the inspected examples it claims most of; of the nearest example if it claims none."""
    p = mixture.shares(examples)
    # Examples of a class weigh together as much as those of any other class.
    weight = np.array([1 / classes.count(c) for c in classes])
    votes = np.stack([(p * weight[:, None])[[c == own for c in classes]].sum(axis=0) for own in CLASSES], axis=1)
    near = [classes[int(np.argmin(((examples - m) ** 2).sum(axis=1)))] for m in mixture.means]
    return [CLASSES[int(np.argmax(v))] if v.sum() > 1e-3 else n for v, n in zip(votes, near)]


def block_statistics(docs: DataFrame, common: frozenset[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with text: the id, the filled characters of each block, and the blocks' statistics end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 8_000_000):
                own = [blocks(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                sizes = pa.array([[filled(x) for x in d] for d in own], pa.list_(pa.int64()))
                stats = pa.array([[v for x in d for v in statistics(x, common)] for d in own], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes, stats], names=[id_column, "sizes", "stats"])

    schema = T.StructType([docs.schema[id_column], T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    full = docs.where(F.length(trimmed(F.col(text_column).cast("string"))) > 0)
    return spread(full.select(id_column, F.col(text_column).cast("string").alias("_text"))).mapInArrow(run, schema)


def fit(stats: DataFrame, common: frozenset[str], rounds: int = 60, gain: float = 1e-2, floor: float = 0.02) -> tuple[np.ndarray, np.ndarray, Mixture, list[str]] | None:
    """Means and widths of the statistics, the mixture fitted to all blocks, and the class of each component. None without blocks.

    Rounds end when one gains less than `gain` of mean log-likelihood per block, at the latest after `rounds`.
    """
    width = len(STATISTICS)
    moments = _total(stats, lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if moments is None or not moments[0]:
        return None
    mean = moments[1 : width + 1] / moments[0]
    wide = np.sqrt(np.maximum(moments[width + 1 :] / moments[0] - mean**2, 4e-4))
    examples = (np.array([statistics(text, common) for _, _, text in EXAMPLES]) - mean) / wide
    mixture = start(examples, [family for _, family, _ in EXAMPLES])
    before = -math.inf
    for _ in range(rounds):
        *sums, likelihood = _total(stats, lambda x, m=mixture: np.append(*m.sums((x - mean) / wide)))
        mixture = Mixture.of(np.reshape(sums, (len(mixture.weights), -1)), width, floor, mixture)
        if likelihood - before < gain * moments[0]:
            break
        before = likelihood
    return mean, wide, mixture, classes_of(mixture, examples, [c for c, _, _ in EXAMPLES])


def class_characters(docs: DataFrame, common_words: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document with text, how many of its filled characters are prose, list, table and junk, and how many there are.

    common_words: word; of fixed size, so it goes to the driver. Result: the id, then n_filled, prose, list, table, junk. A block
    counts as a whole, as its most likely class; prose is likely if its components together are more likely than not. NULL, empty and white-space texts
    have no row; repeated documents come out repeated. Very long texts are read whole.
    """
    common = frozenset(r.word for r in common_words.where(F.col("word").isNotNull()).select("word").distinct().collect())
    stats = stage_table(block_statistics(docs, common, id_column, text_column), "quality")
    fitted = fit(stats, common)
    columns = ["n_filled", *CLASSES]
    schema = T.StructType([stats.schema[id_column], *(T.StructField(c, T.LongType()) for c in columns)])
    if fitted is None:
        return stats.sparkSession.createDataFrame([], schema)
    mean, wide, mixture, classes = fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = np.array([[c == own for c in CLASSES] for own in classes], float)
        for batch in batches:
            sizes, stats = batch.column("sizes"), batch.column("stats")
            x = (np.asarray(stats.flatten()).reshape(-1, len(STATISTICS)) - mean) / wide
            likely = np.concatenate([mixture.shares(x[i : i + 4096]) @ sides for i in range(0, len(x), 4096)] or [np.zeros((0, len(CLASSES)))])
            likely[likely[:, 0] <= 0.5, 0] = -1
            best = likely.argmax(axis=1)
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(sizes).to_numpy(zero_copy_only=False))
            filled_ = np.asarray(sizes.flatten())
            total = np.zeros((batch.num_rows, len(CLASSES)), np.int64)
            np.add.at(total, (doc, best), filled_)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total.sum(axis=1)), *(pa.array(total[:, i]) for i in range(len(CLASSES)))], names=[id_column, *columns])

    return stats.mapInArrow(run, schema)


def not_prose(docs: DataFrame, common_words: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents most of whose filled characters are no prose."""
    found = class_characters(docs, common_words, id_column, text_column)
    return found.where(2 * F.col("prose") < F.col("n_filled")).select(id_column)


def document_statistics(docs: DataFrame, common_words: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The plain statistics of each document, by built-in functions.

    n_words (runs of letters), mean_word_length, symbol_ratio (of filled characters), line_end_share (of non-blank lines, those
    that end in . ! ? or …), common_share (of words). NULL texts have 0 words and no ratios; neither has a ratio of nothing.
    """
    common = sorted(r.word for r in common_words.where(F.col("word").isNotNull()).select("word").distinct().collect())
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    lines = F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), lambda x: F.length(F.regexp_replace(x, "[ \t]", "")) > 0)
    solid = F.regexp_replace(text, "[ \t\r\n]", "")
    d = docs.select(F.col(id_column), words.alias("w"), lines.alias("l"), F.length(solid).alias("filled"), F.length(F.regexp_replace(solid, r"[\p{L}\p{N}]", "")).alias("symbols"))
    n = F.size("w").cast("long")
    return d.select(
        id_column, n.alias("n_words"), F.try_divide(F.length(F.array_join("w", "")).cast("double"), n).alias("mean_word_length"), F.try_divide(F.col("symbols").cast("double"), F.col("filled")).alias("symbol_ratio"),
        F.try_divide(F.size(F.filter("l", lambda x: x.rlike("[.!?…][ \t]*$"))).cast("double"), F.size("l")).alias("line_end_share"),
        F.try_divide(F.size(F.filter("w", lambda w: w.isin(common))).cast("double"), n).alias("common_share"),
    )
