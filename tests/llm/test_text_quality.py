import numpy as np
import pytest

from auditloom.llm.quality_examples import EXAMPLES
from auditloom.llm.text_quality import CLASSES, STATISTICS, Mixture, blocks, class_characters, not_prose, start, statistics

WORDS = ["the", "a", "of", "and", "to", "is", "that", "it", "not", "was", "der", "die", "und", "nicht", "la", "le", "et", "que", "de", "el", "en", "no", "i", "this", "on"]
PROSE = [
    "The new window opens behind the old one, and I could not find a setting for that. It was fine in the release before.",
    "Das neue Fenster öffnet sich hinter dem alten, und ich habe keine Einstellung dafür gefunden. Vorher war das nicht so.",
    "> The new window opens behind the old one, and I could not find\n> a setting for that. It was fine in the release before, and the\n> manual does not say a word about it.",
    "WHY DOES THE NEW WINDOW OPEN BEHIND THE OLD ONE? IT WAS FINE IN THE RELEASE BEFORE.",
]
OTHER = [
    "- first entry of the list\n- second entry of it\n- third entry\n- the last one",
    "| name | size |\n| --- | --- |\n| lamp | 1200 |\n| table | 77 |",
    "build() {\n  cd \"$srcdir/lamp\"\n  cmake -B build -DCMAKE_INSTALL_PREFIX=/usr\n  make -C build\n}",
    "f0a19c3be8d27755aa01c4e9d3b8f6a2417c9e0d",
    "[ 12.041] info: lamp/main.c:17\n[ 12.977] warn: lamp/io.c:230\n[ 13.102] info: lamp/net.c:5",
    "############################################################",
]


@pytest.fixture(scope="module")
def frames(spark):
    # Many plain blocks around the held-out ones, as in a corpus.
    rows = [(i, t) for i, t in enumerate([*PROSE, *OTHER])] + [(1000 + i, e[2]) for i, e in enumerate(EXAMPLES * 3)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, PROSE[0] + "\n\n" + OTHER[2] * 4), (504, OTHER[3] + "\n\n" + PROSE[0] + "\n\n" + PROSE[1]), (505, (PROSE[0] + " ") * 3000)]
    docs = spark.createDataFrame([(*r, "c", "clash") for r in rows], "doc_id long, text string, sizes string, stats string")
    return docs, spark.createDataFrame([("en", w) for w in WORDS] + [("en", None)], "lang string, word string")


def test_held_out_blocks(frames):
    found = {r.doc_id for r in not_prose(*frames).collect()}
    assert not found & {*range(len(PROSE)), 500, 501, 502, 504, 505}
    assert {*range(len(PROSE), len(PROSE) + len(OTHER)), 503} <= found


def test_characters_add_up(frames):
    rows = {r.doc_id: r for r in class_characters(*frames).collect()}
    assert not {500, 501, 502} & set(rows)
    for r in rows.values():
        assert sum(r[c] for c in CLASSES) == r.n_filled > 0


def test_empty(spark, frames):
    assert not_prose(frames[0].limit(0), frames[1]).count() == 0
    assert not_prose(frames[0].where("doc_id IN (500, 501, 502)"), frames[1]).count() == 0


def test_blocks():
    assert blocks("  a\r\n\r\nb\n \n  c\nd  ") == ["a", "b", "  c\nd"]
    assert blocks("a\n\nb\n\nc\n\nd") == ["a\nb\nc\nd"]
    assert blocks("") == []


def test_statistics_are_finite():
    for text in ("", " ", "\u200B", "x", "\x00" * 50, "🙂" * 50, "a" * 100_000, "\n" * 50 + "."):
        values = statistics(text, frozenset(WORDS))
        assert len(values) == len(STATISTICS) and np.isfinite(values).all()


def test_expectation_maximization_finds_two_heaps():
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(-3, 1, (500, 2)), rng.normal(3, 0.5, (1500, 2))])
    m = start(np.array([[-1.0, -1], [1.0, 1]]), ["a", "b"])
    for _ in range(20):
        m = Mixture.of(m.sums(z)[0], 2, 1e-3, m)
    assert np.allclose(sorted(m.weights), [0.25, 0.75], atol=0.02) and np.allclose(m.means[np.argmax(m.weights)], 3, atol=0.1)
    assert np.allclose(m.shares(z).sum(axis=1), 1)


def test_total_counts_every_block_once(spark):
    from auditloom.llm.text_quality import _total

    for n in (1, 1024, 1025, 5000):
        rows = spark.createDataFrame([([0.0] * len(STATISTICS) * n,)], "stats array<double>")
        assert _total(rows, lambda z: np.array([float(len(z))])).tolist() == [float(n)]


def test_partitions_and_batches_change_nothing(spark, frames):
    from auditloom.llm.text_quality import block_statistics, fit

    common = frozenset(WORDS)
    rows = block_statistics(frames[0], common).collect()
    # Every layout holds the same blocks, so the sums differ by rounding only.
    fits = []
    for parts, batch in ((1, 10_000), (4, 500), (8, 10_000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            stats = spark.createDataFrame(rows * 8, "doc_id long, sizes array<long>, stats array<double>").repartition(parts)
            fits.append(fit(stats, common))
            assert sorted(r.doc_id for r in not_prose(frames[0].repartition(parts), frames[1]).collect()) == sorted(r.doc_id for r in not_prose(*frames).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for other in fits[1:]:
        assert np.allclose(other[2].means, fits[0][2].means, atol=1e-6) and other[3] == fits[0][3]
