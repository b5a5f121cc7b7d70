"""Package names and versions."""

from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import IntegerType

#: Suffixes of expected variants of a package.
VARIANTS = ("-git", "-bin", "-svn", "-hg", "-bzr", "-nightly", "-beta", "-dev", "-lts", "-dkms", "-static")
#: Words that say nothing about a package.
STOPWORDS = ("a", "an", "the", "is", "are", "was", "were", "be", "been", "for", "of", "to", "in", "on", "at", "and", "or", "not", "with", "from", "by", "as", "it", "its", "this", "that")


def dependency_name(c: Column) -> Column:
    """A dependency without description and version bound, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.substring_index(c, ":", 1), "[<>=].*$", "")))


def stem(c: Column) -> Column:
    """A name without the suffixes of variants at its end; a name that is nothing but a suffix stays."""
    return F.regexp_replace(c, "(?<=.)(?:" + "|".join(VARIANTS) + ")++$", "")


def version_scheme(v: Column) -> Column:
    """hash, calver, date, semver or other; NULL is other."""
    return (
        F.when(v.rlike("^[a-f][a-f0-9]{6,39}$"), "hash")
        .when(v.rlike(r"^\d{4}\.\d{1,2}(\.\d+)?$"), "calver")
        .when(v.rlike(r"^\d{8}$"), "date")
        .when(v.rlike(r"^\d+\.\d+\.\d+"), "semver")
        .otherwise("other")
    )


def version_parts(v: Column) -> Column:
    """Struct of epoch ('0' if none), pkgver and pkgrel (NULL if none)."""
    rest = F.regexp_replace(v, r"^\d+:", "")
    return F.struct(
        F.when(v.rlike(r"^\d+:"), F.substring_index(v, ":", 1)).otherwise("0").alias("epoch"), F.regexp_replace(rest, "-[^-]*$", "").alias("pkgver"), F.nullif(F.regexp_extract(rest, "-([^-]*)$", 1), F.lit("")).alias("pkgrel")
    )


#: The ranges of line counts.
LINE_EDGES, LINE_BEYOND = ((5, "0-5"), (15, "6-15"), (40, "16-40"), (100, "41-100"), (300, "101-300"), (1000, "301-1000")), "1001+"


def line_bucket(n: Column) -> Column:
    """A line count as one of seven coarse ranges."""
    out = F.when(n < 0, "unknown")
    for most, name in LINE_EDGES:
        out = out.when(n <= most, name)
    return F.when(n.isNull(), "unknown").otherwise(out.otherwise(LINE_BEYOND))


def description_tokens(c: Column) -> Column:
    """The distinct words of a description in lower case, sorted, without stopwords."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9_\-]*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOPWORDS))))


def osa(a: str, b: str, limit: int) -> int:
    """Edits between a and b, where swapping two neighbours is one and no part is edited twice; limit + 1 once beyond.

    Bit-parallel: a column of the table of distances is kept as two words, of the places where it rises and where it falls; bit i stands
    for the first i + 1 characters of a (Hyyrö 2003).

    >>> osa("ab", "ba", 2), osa("ca", "abc", 3), osa("abcd", "xyzw", 2), osa("", "ab", 5)
    (1, 3, 3, 2)
    """
    if not a:
        return min(len(b), limit + 1)
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    rise, fall, kept, before, edits = full, 0, 0, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        swap = (~kept & same) << 1 & before
        kept = ((same & rise) + rise ^ rise | same | fall | swap) & full
        up, down = fall | ~(kept | rise) & full, kept & rise
        edits += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        rise, fall, before = (down | ~(kept | up)) & full, up & kept & full, same
    return min(edits, limit + 1)


@pandas_udf(IntegerType())
def osa_distance(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """osa() of two columns under a limit column; NULL for NULLs."""
    for a, b, k in batches:
        yield pd.Series([None if x is None or y is None else osa(x, y, int(n)) for x, y, n in zip(a, b, k)], dtype="Int32")


def _segments(v: str) -> list[str]:
    out, i = [], 0
    while i < len(v):
        if not v[i].isalnum() or not v[i].isascii():
            i += 1
            continue
        j = i
        while j < len(v) and v[j].isascii() and v[j].isalnum() and v[j].isdigit() == v[i].isdigit():
            j += 1
        out.append(v[i:j])
        i = j
    return out


def _compare_part(a: str, b: str) -> int:
    if a == b:
        return 0
    for x, y in zip_longest(_segments(a), _segments(b)):
        if x is None or y is None:
            # What is left over is later if it is a number, earlier (a pre-release) if it is letters.
            left, sign = (y, -1) if x is None else (x, 1)
            return sign if left.isdigit() else -sign
        if x.isdigit() != y.isdigit():
            return 1 if x.isdigit() else -1
        key = (lambda s: (len(s.lstrip("0")), s.lstrip("0"))) if x.isdigit() else (lambda s: s)
        if key(x) != key(y):
            return 1 if key(x) > key(y) else -1
    return 0


def compare_versions(a: str, b: str) -> int:
    """-1, 0 or 1 as version a is before, the same as or after b: by epoch, then by runs of digits and letters, then by release.

    >>> compare_versions("1:0.9-1", "2.0-1"), compare_versions("1.10", "1.9-3"), compare_versions("1.0rc1", "1.0")
    (1, 1, -1)
    """

    def cut(v: str) -> tuple[str, str, str | None]:
        head, colon, rest = v.partition(":")
        epoch, rest = (head, rest) if colon and head.isdigit() else ("0", v)
        body, dash, rel = rest.rpartition("-")
        return (epoch, body, rel) if dash else (epoch, rest, None)

    (ea, va, ra), (eb, vb, rb) = cut(a), cut(b)
    first = _compare_part(ea, eb) or _compare_part(va, vb)
    return first or (_compare_part(ra, rb) if ra is not None and rb is not None else 0)


def _ranked(v: Column) -> Column:
    """A part of a version as an array of text that sorts as compare_versions() orders: letters before the end, the end before numbers, numbers by value."""
    runs = F.regexp_extract_all(v, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0))

    def one(x: Column) -> Column:
        number = F.ltrim(x, F.lit("0"))
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("2"), F.lpad(F.length(number).cast("string"), 9, "0"), number)).otherwise(F.concat(F.lit("0"), x))

    return F.concat(F.transform(runs, one), F.array(F.lit("1")))


def version_order(a: Column | str, b: Column | str) -> Column:
    """compare_versions() of two columns, in plain expressions; NULL for NULLs."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = version_parts(a), version_parts(b)
    step = lambda p, q: F.when(p < q, -1).when(p > q, 1)
    first = F.coalesce(step(_ranked(x["epoch"]), _ranked(y["epoch"])), step(_ranked(x["pkgver"]), _ranked(y["pkgver"])), step(_ranked(x["pkgrel"]), _ranked(y["pkgrel"])), F.lit(0))
    return F.when(a.isNotNull() & b.isNotNull(), first)
