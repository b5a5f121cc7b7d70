"""Encoding of a whole corpus with a public byte-pair vocabulary, by recursive queries in DuckDB per partition.

Texts are split into words by the vocabulary's pattern. The distinct words of a batch that the task has not met yet become
token-position rows; a recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost
pair of minimum rank until no pair merges. An ordered aggregation gives the ids of each word back.
"""

import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.sources.work import slices, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that splits text before the merges, as published with the vocabulary; white space by Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?=\p{White_Space}|\Z)|\p{White_Space}+"


class Merges(NamedTuple):
    """A vocabulary as arrays: the id of each byte, and the merges (left id, right id, merged id) in the order of rank."""

    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes are themselves, the rest follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load_merges(path: str = VOCABULARY) -> Merges:
    model = json.load(open(path, encoding="utf-8"))["model"]
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Merges(
        np.array([ids[c] for c in byte_letters()], np.int32),
        *(np.array(x, np.int32) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs))),
    )


_CONTRACT = """
WITH RECURSIVE step(n, w, p, tok) AS (
  SELECT 0, w, p, tok FROM symbols
  UNION ALL
  SELECT n + 1, w, p, CASE WHEN p = best.p_ THEN best.merged_ ELSE tok END
  FROM (
    SELECT *, min(CASE WHEN rank IS NOT NULL THEN {'r': rank, 'p_': p, 'merged_': merged} END) OVER (PARTITION BY w) AS best
    FROM (SELECT n, w, p, tok, lead(tok) OVER pairs AS after, lag(p) OVER pairs AS before_p FROM step WINDOW pairs AS (PARTITION BY w ORDER BY p)) AS neighbours
    LEFT JOIN merges ON merges.l = neighbours.tok AND merges.r = neighbours.after)
  WHERE best IS NOT NULL AND before_p IS DISTINCT FROM best.p_),
settled AS (SELECT w, max(n) AS n FROM step GROUP BY w)
SELECT w, list(tok ORDER BY p) AS ids FROM step JOIN settled USING (w, n) GROUP BY w
"""

#: The same contraction for one long word, at most $steps steps of it. Where every pair with the token that a merge makes ranks behind that merge (`apart`), the
#: places to the right would be the next in any case, so a step takes all places of the pair of minimum rank from the left; of places that overlap
#: (one letter again and again) every other one. Else it takes the leftmost. The last step's rows come out, in order, and how many steps there were.
_CONTRACT_LONG = """
WITH RECURSIVE step(n, p, tok) AS (
  SELECT 0, p, tok FROM symbols
  UNION ALL
  SELECT n + 1, p, CASE WHEN takes THEN merged ELSE tok END
  FROM (
    SELECT *, lag(takes, 1, false) OVER (ORDER BY p) AS taken
    FROM (
      SELECT *, hit AND CASE WHEN apart THEN row_number() OVER (PARTITION BY gap, hit ORDER BY p) % 2 = 1 ELSE p = min(CASE WHEN hit THEN p END) OVER () END AS takes
      FROM (
        SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS gap
        FROM (
          SELECT *, rank IS NOT NULL AND rank = min(rank) OVER () AS hit, count(rank) OVER () AS open
          FROM (SELECT n, p, tok, lead(tok) OVER (ORDER BY p) AS after FROM step WHERE n < $steps) AS neighbours
          LEFT JOIN merges ON merges.l = neighbours.tok AND merges.r = neighbours.after))))
  WHERE open > 0 AND NOT taken)
SELECT p, tok, n FROM step WHERE n = (SELECT max(n) FROM step) ORDER BY p
"""


class WordEncoder:
    """Words to ids. Keeps what it has met up to `remember` words; its queries keep about `symbols` token rows at once, and one word's at least.

    Words of up to `longest` bytes are contracted many in a query; a longer one has its own, whose steps are as many as the different merges it needs.
    """

    def __init__(self, merges: Merges, remember: int = 300_000, symbols: int = 60_000, longest: int = 256, memory: str = "400MB"):
        self.byte_ids, self.remember, self.symbols, self.longest = merges.byte_ids, remember, symbols, longest
        self.known: dict[str, tuple[int, ...]] = {}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        rank = np.arange(len(merges.left), dtype=np.int32)
        earliest = np.full(max(map(int, (merges.left.max(), merges.right.max(), merges.merged.max()))) + 1, len(rank), np.int32)
        np.minimum.at(earliest, merges.left, rank)
        np.minimum.at(earliest, merges.right, rank)
        table = pa.table({"l": merges.left, "r": merges.right, "rank": rank, "merged": merges.merged, "apart": earliest[merges.merged] > rank})
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.split = regex.compile(PATTERN)

    def _contract(self, words: list[tuple[str, bytes]]) -> None:
        sizes = [len(b) for _, b in words]
        at = np.frombuffer(b"".join(b for _, b in words), np.uint8)
        starts = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        rows = pa.table(
            {"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "p": (np.arange(len(at)) - starts).astype(np.int32), "tok": self.byte_ids[at]}
        )
        self.db.register("symbols", rows)
        out = self.db.sql(_CONTRACT).to_arrow_table()
        self.db.unregister("symbols")
        for w, ids in zip(out.column("w").to_pylist(), out.column("ids").to_pylist()):
            self.known[words[w][0]] = tuple(ids)

    def _contract_long(self, text: bytes) -> tuple[int, ...]:
        """One long word by the query, some steps at a time, so that what it keeps of all steps stays bounded."""
        tok = self.byte_ids[np.frombuffer(text, np.uint8)]
        while True:
            steps = max(1, self.symbols // len(tok))
            self.db.register("symbols", pa.table({"p": np.arange(len(tok), dtype=np.int32), "tok": tok}))
            out = self.db.sql(_CONTRACT_LONG, params={"steps": steps}).to_arrow_table()
            self.db.unregister("symbols")
            tok = out.column("tok").to_numpy()
            if out.column("n")[0].as_py() < steps:
                return tuple(tok.tolist())

    def learn(self, words: set[str]) -> None:
        """Make the ids of all these words known."""
        new = sorted(((w, w.encode()) for w in words if w not in self.known), key=lambda x: (len(x[1]), x[0]))
        chunk: list[tuple[str, bytes]] = []
        for w, b in new:
            if len(b) > self.longest:
                self.known[w] = self._contract_long(b)
                continue
            # Words of one length take about as many steps, each of which keeps all their rows.
            if chunk and (len(chunk) + 1) * len(b) * max(1, len(b) // 8) > self.symbols:
                self._contract(chunk)
                chunk = []
            chunk.append((w, b))
        if chunk:
            self._contract(chunk)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for NULL and the empty text."""
        split = [self.split.findall(t) if t else [] for t in texts]
        if len(self.known) > self.remember:
            self.known.clear()
        self.learn(set(chain.from_iterable(split)))
        return [list(chain.from_iterable(map(self.known.__getitem__, words))) for words in split]


def encode_corpus(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document with the ids of its text, without special tokens.

    Result: the id column and ids ARRAY<INT>. NULL and the empty text have no ids, so an empty array. Marker-like strings such
    as the end-of-text token's are ordinary text. Repeated rows come out repeated; other columns are ignored.
    """
    merges = docs.sparkSession.sparkContext.broadcast(load_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for a, b in slices(batch.column(1), 4_000_000):
                encoder = encoder or WordEncoder(merges.value)
                ids = encoder.encode(batch.column(1).slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    schema = T.StructType([docs.schema[id_column], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(docs.select(id_column, F.col(text_column).cast("string").alias("_text"))).mapInArrow(run, schema)
