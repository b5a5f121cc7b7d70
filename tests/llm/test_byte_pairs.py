import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from auditloom.llm.byte_pairs import VOCABULARY, Merges, WordEncoder, encode_corpus, load_merges


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(load_merges())


def test_fuzz(public, encoder):
    rng = random.Random(3)
    letters = list(" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\uFEFF\u200B'sdtremAB12ßé漢字🙂\x00<|>endoftext١²")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert encoder.encode(texts) == [public(t) for t in texts]


@pytest.mark.parametrize("text", ["<|endoftext|>", "x" * 5000, "ab" * 3000, "the " * 5000, "\n" * 300, "naïve façade — 東京\r\n", "a" * 257, "zqxj" * 70])
def test_long_and_odd(public, encoder, text):
    assert encoder.encode([text]) == [public(text)]


def test_long_words_and_many_words_agree(encoder, public):
    rng = random.Random(1)
    together = WordEncoder(load_merges(), longest=10_000, symbols=10**9)
    stepwise = WordEncoder(load_merges(), longest=1, symbols=700)
    for n in (1, 2, 40, 300, 700):
        word = "".join(rng.choice("abcdefgh") for _ in range(n))
        assert together.encode([word]) == stepwise.encode([word]) == [public(word)]


@pytest.mark.parametrize("text", ["=" * 200_001, "\u6771\u4eac\u90fd" * 7000, " " * 100_000 + "x", "aaab" * 9000])
def test_very_long_words(encoder, public, text):
    assert encoder.encode([text]) == [public(text)]


def test_a_merge_that_makes_an_earlier_pair_possible():
    """abc comes of (a, bc) first, of (ab, c) later; (abc, ab) ranks between: only the leftmost (ab, c) may be taken at once."""
    a, b, c, bc, ab, abc, abcab = 97, 98, 99, 300, 301, 302, 303
    rows = [(a, b, ab), (b, c, bc), (a, bc, abc), (abc, ab, abcab), (ab, c, abc)]
    merges = Merges(np.arange(256, dtype=np.int32), *(np.array(x, np.int32) for x in zip(*rows)))
    for longest in (1, 100):
        assert WordEncoder(merges, longest=longest).encode(["abcabcabc"]) == [[abcab, c, abc]]


def test_long_mixed_letters(encoder, public):
    rng = random.Random(2)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))
    assert encoder.encode([word]) == [public(word)]


def test_forgetting_changes_nothing(public):
    small = WordEncoder(load_merges(), remember=3, symbols=50)
    texts = ["one two three four", "five six seven one", "two three nine ten"] * 3
    assert [small.encode([t])[0] for t in texts] == [public(t) for t in texts]


def test_corpus(spark, public):
    rows = [(1, "Hello world", "c"), (2, None, "c"), (3, "", "c"), (4, "  ", "c"), (4, "  ", "c"), (None, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df).collect()), key=str)
    assert got == sorted(((i, public(t) if t else []) for i, t, _ in rows), key=str)
    assert encode_corpus(df.limit(0)).count() == 0
    assert encode_corpus(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"


def test_documents(spark, sf, public):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.ids for r in encode_corpus(docs).collect()} == {i: public(t) if t else [] for i, t in texts.items()}
