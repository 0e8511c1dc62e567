"""Queries of this subpackage for the driver, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import language_id, licenses, media, secrets, warc
from folioforge.llm.digest_index import DigestIndex
from folioforge.llm.jaccard_join import jaccard_components
from folioforge.llm.line_dedup import dedup_lines
from folioforge.llm.packing import pack
from folioforge.llm.tokenize import digests, encode
from folioforge.session import ship


def vocabulary() -> str:
    """Path of the public vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the driver's."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    prototypes = language_id.fit(docs.filter(language_id.remainder() != 0))
    out = language_id.identify(docs.select("doc_id", "text"), prototypes)
    return out.select("doc_id", F.coalesce(language_id.remainder() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: base patterns, and credential values that are hard to guess."""
    return secrets.summary(secrets.scan(table(spark, sf_dir, "documents")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision on every document, against an index that begins empty."""
    out = DigestIndex(spark).add(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, and of the text decoded from them."""
    return digests(encode(table(spark, sf_dir, "documents"), vocabulary(), decode=True))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    pages = table(spark, sf_dir, "pages")
    archives, folder = warc.archive_pages(pages)
    kind = pages.schema["page_id"].dataType
    rows = warc.read(archives, folder, payload=False).filter("last")
    return rows.select(
        F.col("record_id").try_cast(kind).alias("page_id"),
        F.when(F.col("refers_to").isNull(), F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast(kind).alias("refers_to"),
    )


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary(), 2048, 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go from every document, and the digest of what stays."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media columns of every document's payload, filled from what was stored."""
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licences that every document, or a part of it, is."""
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.concat_ws(",", "licenses").alias("licenses"), "whole_license", "n_units", "canonical_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_exact_dedup, op4_jaccard_join, op5_bpe, op6_warc, op7_pack, op8_line_dedup, op9_media, op10_licenses)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": r"""
            WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
            w AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS k,
                         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                         count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
            SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM w""",
        "op6_warc": """
            WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to FROM w""",
    }
