"""Indicators of known bad: normalising, matching with expiry, and the way back from an indicator to whom it touches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.urls import parent_domains


def indicator_type(value: Column) -> Column:
    """hash for hexadecimal digests of a known length, domain for dotted names, else package."""
    return (
        F.when(value.rlike("^[0-9A-Fa-f]+$") & F.length(value).isin(32, 40, 56, 64, 96, 128), "hash")
        .when((F.length(value) <= 255) & value.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9\-]*\.)+[A-Za-z0-9\-]+\.?$") & value.rlike("[A-Za-z]"), "domain")
        .otherwise("package")
    )


def normalised(kind: Column, value: Column) -> Column:
    """Trimmed and in lower case; a domain without the dot at its end; a package as written."""
    v = F.trim(value)
    return F.when(kind == "domain", F.regexp_replace(F.lower(v), r"\.+$", "")).when(kind == "hash", F.lower(v)).otherwise(v)


def is_expired(expires_at: Column, as_of: Column) -> Column:
    """Has the time passed; an unreadable or missing time never has."""
    return F.coalesce(expires_at.try_cast("timestamp") < as_of, F.lit(False))


def matches(facts: DataFrame, indicators: DataFrame, as_of: Column) -> DataFrame:
    """subject, kind, value, source, confidence, expired, surface: one row per subject and indicator, the first surface by name.

    facts: subject, kind, value, surface. indicators: kind, value, source, confidence, expires_at. Domains match the fact's host
    and each of its parents. Expired indicators still match, flagged.
    """
    widened = facts.select("subject", "surface", "kind", F.explode(F.when(F.col("kind") == "domain", parent_domains(F.col("value"))).otherwise(F.array("value"))).alias("value"))
    hits = widened.join(indicators, ["kind", "value"])
    first = hits.groupBy("subject", "kind", "value", "source").agg(F.min("surface").alias("surface"), F.max("confidence").alias("confidence"), F.max("expires_at").alias("expires_at"))
    return first.withColumn("expired", is_expired(F.col("expires_at"), as_of)).drop("expires_at")


def pivot(surfaces: list[tuple[str, DataFrame]], indicator: str) -> DataFrame:
    """subject, surface: everything that an indicator touches, by the first of the surfaces (name, rows of subject and value) that shows it."""
    out = None
    for i, (name, rows) in enumerate(surfaces):
        own = rows.where(F.col("value") == indicator).select("subject", F.struct(F.lit(i).alias("at"), F.lit(name).alias("surface")).alias("s"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("subject").agg(F.min("s").alias("s")).select("subject", F.col("s.surface").alias("surface"))
