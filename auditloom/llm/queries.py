"""The queries of the problems on training data: 1, 6, 7 and 8."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.text import hash_key, url_key
from auditloom.llm import byte_pairs, mixing, seen_keys, text_quality
from auditloom.sources import table

_KEYED = ["source_urls", "maintainers_hashed"]


def _keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    urls = table(spark, d, "source_urls").select(F.lit("source_urls").alias("table_name"), F.col("id").alias("record_id"), F.col("imported_at").alias("at"), url_key(F.col("url")).alias("key"))
    hashes = table(spark, d, "maintainers_hashed").select(F.lit("maintainers_hashed").alias("table_name"), F.col("row_id").alias("record_id"), F.col("imported_at").alias("at"), hash_key(F.col("name_hash")).alias("key"))
    known = F.when(F.col("table_name") == "source_urls", url_key(F.col("known_key"))).when(F.col("table_name") == "maintainers_hashed", hash_key(F.col("known_key")))
    return urls.unionByName(hashes), table(spark, d, "seed_keys").select("table_name", known.alias("key"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose key occurred before, among the seed keys or in an earlier record."""
    return seen_keys.seen_records(*_keyed(spark, d), _KEYED)


def p1_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often the filters mark wrongly, by their own records and by known absent keys."""
    return seen_keys.error_rates(*_keyed(spark, d), _KEYED)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return byte_pairs.encode_corpus(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mix of the documents' sources at their target weights."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.mix_shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not natural prose."""
    return text_quality.not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Per document the characters of each class."""
    return text_quality.class_characters(table(spark, d, "documents"), table(spark, d, "common_words"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The plain statistics of every document."""
    return text_quality.document_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


QUERIES = {
    "p1_found": p1_found,
    "p1_error_rates": p1_error_rates,
    "p6_ids": p6_ids,
    "p7_mixture": p7_mixture,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_statistics": p8_statistics,
}

_WS = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

SQL = {
    "p1_found": rf"""
WITH raw AS (
  SELECT 'source_urls' AS table_name, id AS record_id, imported_at AS ts, url AS k, false AS seed FROM source_urls
  UNION ALL SELECT 'maintainers_hashed', row_id, imported_at, name_hash, false FROM maintainers_hashed
  UNION ALL SELECT table_name, NULL, NULL, known_key, true FROM seed_keys),
bare AS (SELECT *, trim(k, {_WS}) AS b FROM raw),
cut AS (SELECT *, rtrim(b, '/') AS u, regexp_extract(rtrim(b, '/'), '^(.+?)://([^/?#]*)((?s:.*))$', ['s', 'a', 'r']) AS x FROM bare),
host AS (SELECT *, lower(x.s) AS s, regexp_replace(lower(regexp_replace(x.a, '^.*@', '')), '\.(:\d*)?$', '\1') AS h FROM cut),
keyed AS (
  SELECT table_name, record_id, ts, seed,
         CASE WHEN table_name = 'maintainers_hashed' THEN regexp_replace(lower(b), '^sha256:', '') WHEN x.s = '' THEN u
              ELSE s || '://' || CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') WHEN s = 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || x.r END AS key FROM host),
ordered AS (SELECT *, row_number() OVER (PARTITION BY table_name, key ORDER BY seed DESC, ts, record_id) AS n FROM keyed WHERE key <> '')
SELECT table_name, record_id FROM ordered WHERE NOT seed AND n > 1
""",
    "p8_statistics": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w,
         list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '') AS l,
         regexp_replace(text, '[ \t\r\n]', '', 'g') AS solid FROM t)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, ''))::DOUBLE / nullif(len(w), 0) AS mean_word_length,
       length(regexp_replace(solid, '[\p{L}\p{N}]', '', 'g'))::DOUBLE / nullif(length(solid), 0) AS symbol_ratio,
       len(list_filter(l, lambda x: regexp_matches(x, '[.!?…][ \t]*$')))::DOUBLE / nullif(len(l), 0) AS line_end_share,
       len(list_filter(w, lambda x: list_contains(known, x)))::DOUBLE / nullif(len(w), 0) AS common_share
FROM parts, (SELECT list(word) AS known FROM common_words)
""",
}
