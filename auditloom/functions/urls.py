"""Urls: hosts, parents, templates, provenance buckets, pinning."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import let

#: Limits of a host name in DNS: labels and bytes.
MOST_LABELS, MOST_BYTES = 127, 253


def authority(url: Column) -> Column:
    """What stands between `://` and the path, '' without."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def canonical_host(netloc: Column) -> Column:
    """One spelling per host: no user info, no port 80 or 443, no dots at the end, lower case. Brackets hold an IPv6 host."""
    bare = F.regexp_replace(netloc, "^.*@", "")
    bracketed = F.regexp_extract(bare, r"^(\[[^\]]*\])([^:]*)", 0)
    plain = F.regexp_replace(F.regexp_replace(bare, r"^([^:]*):(?:80|443)?$", "$1"), r"\.+$", "")
    return F.lower(F.when(bracketed != "", F.regexp_replace(bracketed, r"\.+$", "")).otherwise(plain))


def bounded_host(host: Column) -> Column:
    """The rightmost labels of a host within DNS limits: that part decides what it is."""
    labels = F.array_join(F.slice(F.split(host, r"\."), -F.least(F.size(F.split(host, r"\.")), F.lit(MOST_LABELS)), MOST_LABELS), ".")
    return let(labels, lambda h: F.when(F.length(h) > MOST_BYTES, F.regexp_replace(F.substring(h, -MOST_BYTES, MOST_BYTES), r"^[^.]*\.(?=.)", "")).otherwise(h))


def host_of(url: Column) -> Column:
    return bounded_host(canonical_host(authority(url)))


def parent_domains(host: Column) -> Column:
    """The host and each of its parents, longest first. As many as the host has labels, which bounded_host bounds."""
    return let(F.split(host, r"\."), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.lit(MOST_LABELS)), ".")))


def registered_domain(host: Column) -> Column:
    """The last two labels of the host without port; there is no list of public suffixes here."""
    return F.regexp_extract(F.substring_index(host, ":", 1), r"[^.]+\.[^.]+$", 0)


def template(url: Column) -> Column:
    """A url as a version-stable template: versions are 0, long hexadecimal runs HASH, dates DATE; no slashes at the end."""
    u = F.regexp_replace(url, r"(?i)\bv?\d+(?:\.\d+){1,50}\b", "0")
    u = F.regexp_replace(u, r"(?i)\b[0-9a-f]{32,}\b", "HASH")
    u = F.regexp_replace(u, r"\b(?:19|20)\d{2}-?\d{2}-?\d{2}\b", "DATE")
    return F.rtrim(u, F.lit("/"))


#: What in a url names a branch, and what a tag or version.
_BRANCH = r'(?i)/branches?/|/heads/|/master[./"]|/main[./"]|/develop[./"]'
_TAG, _VERSION = r"(?i)/releases?/|/tags?/|/download/", r"(?:^|/)(?:v\d+(?:\.\d+){0,50}|\d+(?:\.\d+){1,50})(?:/|$|\.)"


def pinning_level(url: Column, checksum: Column) -> Column:
    """How firmly a url names its content: checksum_pinned, branch_pinned, tag_pinned or unpinned."""
    return (
        F.when(checksum, "checksum_pinned")
        .when(url.rlike(_BRANCH), "branch_pinned")
        .when(url.rlike(_TAG) | url.rlike(_VERSION), "tag_pinned")
        .otherwise("unpinned")
    )


def bucketed(rows: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """rows with `bucket`: raw_hosting if the host itself is listed so, trusted_forge if it or a parent is, official likewise, else unknown.

    domains: domain, kind. A suffix equi-join over the distinct hosts' parent domains, not over the rows.
    """
    hosts = rows.select(F.col(host).alias("_h")).where(F.col(host).isNotNull()).distinct()
    parents = hosts.select("_h", F.posexplode(parent_domains(F.col("_h"))).alias("_at", "domain")).join(domains, "domain")
    ranked = parents.where((F.col("_at") == 0) | (F.col("kind") != "raw_hosting"))
    rank = F.when(F.col("kind") == "raw_hosting", 0).when(F.col("kind") == "trusted_forge", 1).otherwise(2)
    best = ranked.groupBy("_h").agg(F.min(rank).alias("_r"))
    bucket = F.when(F.col("_r") == 0, "raw_hosting").when(F.col("_r") == 1, "trusted_forge").when(F.col("_r") == 2, "official").otherwise("unknown")
    return rows.join(best, F.col(host) == F.col("_h"), "left").withColumn("bucket", bucket).drop("_h", "_r")
