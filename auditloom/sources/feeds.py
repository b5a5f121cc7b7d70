"""Sources and sinks beyond plain tables: indicator feeds, seeds, trees of files, snapshots, canonical artifacts, reports."""

import hashlib
import json
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.payload import is_archive
from auditloom.operators.indicators import normalised
from auditloom.operators.trees import is_carrier

INDICATOR = "type string, value string, confidence string, provenance string, campaign string, source string, added string, expires_at string"
_CONFIDENCE = ("confirmed", "high", "medium")
_TYPES = ("domain", "package", "hash")


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL feed of indicators: kind, value (normalised), source, confidence, expires_at; one row per (kind, value, source).

    A line that is no JSON object fails the read; a row of unknown type or without a value is left out; an unknown confidence is medium.
    """
    rows = spark.read.schema(INDICATOR).option("mode", "FAILFAST").json(path)
    return valid_indicators(rows)


def valid_indicators(rows: DataFrame) -> DataFrame:
    kind = F.lower(F.trim("type"))
    value = normalised(kind, F.col("value"))
    known = rows.select(
        kind.alias("kind"), value.alias("value"), F.coalesce("source", F.lit("")).alias("source"), F.when(F.lower("confidence").isin(*_CONFIDENCE), F.lower("confidence")).otherwise("medium").alias("confidence"), "expires_at"
    ).where(kind.isin(*_TYPES) & (F.length(value) > 0))
    return known.groupBy("kind", "value", "source").agg(F.min("confidence").alias("confidence"), F.max("expires_at").alias("expires_at"))


def read_indicator_list(spark: SparkSession, path: str) -> DataFrame:
    """A TOML list of indicators ([[indicator]] tables), a small configuration file read on the driver."""
    given = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("indicator", [])
    fields = [f.split(" ")[0] for f in INDICATOR.split(", ")]
    return valid_indicators(spark.createDataFrame([tuple(None if g.get(f) is None else str(g[f]) for f in fields) for g in given], INDICATOR))


def merge_urls(seeds: DataFrame) -> DataFrame:
    """Seeded urls as one row per url: the package and time of the first arrival by id, the uses added up, the last time seen."""
    first = F.min(F.struct("id", "first_seen_package_id", "first_seen_globally_timestamp")).alias("f")
    out = seeds.where(F.col("url").isNotNull()).groupBy("url").agg(first, F.sum("total_uses").cast("long").alias("total_uses"), F.max("last_seen_timestamp").alias("last_seen_timestamp"))
    return out.select("url", "f.first_seen_package_id", "f.first_seen_globally_timestamp", "total_uses", "last_seen_timestamp")


def tree_manifest(spark: SparkSession, folder: str, head: int = 4096) -> DataFrame:
    """The files below a folder: path, length, the first bytes, and the whole content of what is read to its end (carriers, archives), NULL for others.

    Only the bytes that are kept leave the reader's row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.substring("content", 1, head).alias("head"), F.when(is_carrier(F.col("path")) | is_archive(F.col("content")), F.col("content")).alias("content"))


def changed_members(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_oid, new_oid of the members whose content id differs between two manifests (path, oid), or that are in one only."""
    both = old.select("path", F.col("oid").alias("old_oid")).join(new.select("path", F.col("oid").alias("new_oid")), "path", "full_outer")
    return both.where(~F.col("old_oid").eqNullSafe(F.col("new_oid")))


def write_snapshot(packages: DataFrame, folder: str, snapshot_time: int) -> None:
    """A registry snapshot as one partition by its time; written again, it replaces itself and nothing else."""
    packages.write.mode("overwrite").parquet(f"{folder}/snapshot_time={snapshot_time}")


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(folder)


def snapshot_age(as_of: Column, taken: Column) -> Column:
    """Seconds since a snapshot, none below 0; NULL (unknown) counts as stale elsewhere."""
    return F.greatest(F.lit(0).cast("long"), as_of - taken)


def append_history(findings: DataFrame, folder: str, day: str) -> None:
    """Findings of a day as a partition by date; a rerun of the day replaces it, so history doesn't double."""
    findings.write.mode("overwrite").parquet(f"{folder}/date={day}")


def canonical_json(row: Column) -> Column:
    """A struct as JSON text with its fields in their order and NULLs left in: equal rows give equal text."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def write_artifact(rows: DataFrame, folder: str, key: str) -> str:
    """Rows as sorted canonical JSON lines, in order over the part files, and the hash of all lines' hashes; the hash is returned.

    The lines' digests are combined by order-free sums, so the hash needs no single task to see all lines.
    """
    lines = rows.select(F.col(key).alias("_k"), canonical_json(F.struct(*sorted(rows.columns))).alias("value"))
    lines.repartitionByRange("_k").sortWithinPartitions("_k", "value").select("value").write.mode("overwrite").text(folder)
    return _lines_hash(lines)


def _lines_hash(lines: DataFrame) -> str:
    parts = [F.conv(F.substring(F.sha2("value", 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = lines.agg(*(F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{i}") for i, p in enumerate(parts)), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(json.dumps([*sums], default=str).encode()).hexdigest()


def read_artifact(spark: SparkSession, folder: str, schema: str, expected: str) -> DataFrame:
    """The rows of an artifact that write_artifact() wrote; a ValueError if its lines do not give the expected hash."""
    lines = spark.read.text(folder)
    if _lines_hash(lines) != expected:
        raise ValueError(f"{folder} is not the artifact that was expected")
    kind = spark.createDataFrame([], schema).schema
    return lines.select(F.from_json("value", kind).alias("r")).select("r.*")


METADATA = "Name string, PackageBase string, Maintainer string, Version string, LastModified long, FirstSubmitted long, URL string, Depends array<string>, MakeDepends array<string>, CheckDepends array<string>, OptDepends array<string>, Provides array<string>, Replaces array<string>"


def read_metadata_dump(spark: SparkSession, path: str) -> DataFrame:
    """A registry dump: files of one JSON array of packages each, plain or compressed by gzip; entries without a name are left out. A file is read by one task, so a large dump should come in several."""
    return spark.read.schema(METADATA).option("multiLine", "true").json(path).where("Name IS NOT NULL")


def bounded_bytes(text: Column, limit: int) -> Column:
    """Is the text longer than so many bytes: such a diff is flagged, not cut."""
    return F.octet_length(text) > limit


def newest_commits(commits: DataFrame, n: int) -> DataFrame:
    """The n newest commits of each repo (repo, commit_time, sha), newest first as rank 1; each salt's newest are found first."""
    salted = commits.withColumn("_s", F.pmod(F.xxhash64("sha"), F.lit(16)))
    down = [F.desc("commit_time"), F.desc("sha")]
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "_s").orderBy(*down))).where(F.col("rank") <= n).drop("rank", "_s")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*down))).where(F.col("rank") <= n)
