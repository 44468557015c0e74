"""Registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import text_queries
from cohortkit.llm.exact_dedup import exact_duplicates
from cohortkit.llm.fingerprints import fingerprint_with_edits
from cohortkit.llm.jaccard_join import Likeness, near_duplicates
from cohortkit.llm.mixing import mix_sources
from cohortkit.llm.packing import pack_documents
from cohortkit.llm.pii import KINDS, find_personal_data, spans_text
from cohortkit.llm.sharding import shard_by_size
from cohortkit.llm.ship import ship
from cohortkit.llm.token_files import read_token_files, token_digests, write_token_files
from cohortkit.llm.toxicity import fit_toxicity, fold, score_toxicity
from cohortkit.llm.warc import page_records, read_warc, write_warc
from cohortkit.sources import new_path, table

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = 40


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, directory: str) -> DataFrame:
    ship(spark)
    return table(spark, directory, "documents")


def op1_warc(spark: SparkSession, directory: str) -> DataFrame:
    ship(spark)
    path = new_path(spark)
    write_warc(page_records(table(spark, directory, "pages")), path)
    columns = ["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    pages = read_warc(spark, path, columns).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.substring_index(c, ":", -1).try_cast("bigint")
    return pages.select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op2_packing(spark: SparkSession, directory: str) -> DataFrame:
    pieces = pack_documents(_documents(spark, directory), tokenizer_file("word_bpe_49k.json"), 2)
    return pieces.drop("tokens")


def op3_mix_sources(spark: SparkSession, directory: str) -> DataFrame:
    return mix_sources(_documents(spark, directory), (5, 2, 1), 1.5, 2).drop("row")


def op4_personal_data(spark: SparkSession, directory: str) -> DataFrame:
    found = find_personal_data(_documents(spark, directory))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(spans_text("base"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
    )


def op5_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = _documents(spark, directory)
    model = fit_toxicity(docs, table(spark, directory, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted"
    )


def op6_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    found = near_duplicates(_documents(spark, directory), Likeness(4, 85, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return fingerprint_with_edits(_documents(spark, directory))


def op8_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_duplicates(_documents(spark, directory), keep="largest")


def op9_sharding(spark: SparkSession, directory: str) -> DataFrame:
    placed = shard_by_size(_documents(spark, directory), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_token_files(spark: SparkSession, directory: str) -> DataFrame:
    path = new_path(spark)
    write_token_files(_documents(spark, directory), path, tokenizer_file("byte_bpe_50k.json"), 0)
    digests = token_digests(read_token_files(spark, path))
    return digests.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {
    q.__name__: q for q in (op1_warc, op2_packing, op3_mix_sources, op4_personal_data, op5_toxicity, op6_jaccard_join, op7_fingerprints, op8_exact_dedup, op9_sharding, op10_token_files)
} | text_queries.QUERIES

SQL: dict[str, str] = {
    "op1_warc": """
WITH t AS (
  SELECT page_id, coalesce(html, '') AS payload, upper(sha1(coalesce(html, ''))) AS digits
  FROM pages),
 g AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS first FROM t)
SELECT page_id, strlen(payload) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(digits, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT)
          >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
 s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2),
                        lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
  FROM t),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
 l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
 reach AS (
  SELECT doc_id, doc_id AS other FROM t
  UNION
  SELECT reach.doc_id, l.b FROM reach JOIN l ON l.a = reach.other)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
FROM t JOIN reach ON reach.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id
GROUP BY t.doc_id
""",
    "op8_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
""",
} | text_queries.SQL
