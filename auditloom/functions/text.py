"""Trimming, case and key spellings."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space, by Unicode's property rather than a list.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def trimmed(c: Column) -> Column:
    """Without white space at both ends, tabs and line ends included. NULL stays NULL."""
    return F.btrim(c, F.lit(WHITESPACE))


def name_key(c: Column) -> Column:
    """Trimmed, in lower case."""
    return F.lower(trimmed(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def url_key(c: Column) -> Column:
    """The identity of a url.

    Trimmed; scheme and host in lower case; no user info, no final dot of the host, no port 80 of http or 443 of https, no
    slashes at the very end. All else counts as written; a string without `://` only loses white space and slashes.
    """

    def front(p: Column) -> Column:
        p = F.regexp_replace(F.lower(p), "(?s)://.*@", "://")
        p = F.regexp_replace(p, r"\.(?=(?::[0-9]*)?$)", "")
        return F.regexp_replace(p, "(?s)^(http://.*):80$|^(https://.*):443$", "$1$2")

    def whole(u: Column) -> Column:
        return let(
            F.regexp_extract(u, "(?s)^.+?://[^/?#]*", 0),
            lambda p: F.when(p == "", u).otherwise(F.concat(front(p), F.substring(u, F.length(p) + 1, F.length(u)))),
        )

    return let(F.rtrim(trimmed(c), F.lit("/")), whole)


def hash_key(c: Column) -> Column:
    """The identity of a hash: trimmed, in lower case, without a leading `sha256:`."""
    low = name_key(c)
    return F.when(low.startswith("sha256:"), F.substring(low, F.lit(8), F.length(low))).otherwise(low)


def version_key(c: Column) -> Column:
    """Trimmed; an epoch of `0:` is the same as none."""
    v = trimmed(c)
    return F.when(v.startswith("0:"), F.substring(v, F.lit(3), F.length(v))).otherwise(v)


def epoch_seconds(c: Column) -> Column:
    """Text timestamp of any of the mixed forms as whole epoch seconds; no offset means UTC; NULL where unreadable."""
    t = trimmed(c)
    zoned = F.when(t.rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$") & t.contains(":"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.unix_seconds(zoned.try_cast("timestamp"))
