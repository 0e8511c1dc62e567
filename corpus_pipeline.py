"""A training corpus from raw documents, in stages over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import language_id, packing, secrets
from folioforge.llm.digest_index import DigestIndex
from folioforge.llm.jaccard_join import one_of_each
from folioforge.llm.queries import vocabulary
from folioforge.llm.storage import staged
from folioforge.session import ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those that are null or without a letter are rejected."""
    ship(spark)
    prototypes = language_id.fit(docs.filter(language_id.remainder() != 0))
    pred, score = (next(n for n in (base, f"_{base}", f"__{base}") if n not in docs.columns) for base in ("lang_pred", "score"))
    out = language_id.identify(docs, prototypes, pred_col=pred, score_col=score)
    known = (F.col(pred) != language_id.UNKNOWN) | (F.col(score) > 0)  # a corpus can have a language of that name
    return out.filter(known).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for blanks."""
    ship(spark)
    return DigestIndex(spark).kept(docs, fixed=True)  # each stage's documents are a table of files


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.75 or more of five-word shingles connect."""
    ship(spark)
    return one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets in its text replaced by a sign."""
    ship(spark)
    out = secrets.mask(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, vocabulary(), 2048, 0)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("pack", pack_sequences),
]

#: SQL has no tokenizer, and no language profiles: tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
