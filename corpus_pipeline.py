"""Training corpus from documents: language, lines, near copies, mixture, token ids.

Each stage is written as Parquet and read again, so a lost executor costs a stage's tasks, not the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostwatch.llm import bpe, common, jaccard_join, language_id, line_dedup, mixing


#: Least score of a text that fits a learned language: none of its n-grams is in any profile at 0.
LEAST_FIT = 1e-9


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, those without a letter, and those as far as can be from every
    learned language. Where no row is labelled, documents with a letter stay. All others stay as they are."""
    profiles = language_id.learn(docs.filter(~language_id.held_out(4)).select("lang", "text"))
    if not profiles:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.predict(docs.select(F.struct(*docs.columns).alias("row_"), "text"), profiles, keep=["row_"])
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_FIT)).select("row_.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more in three documents or more stay in the largest doc_id; n_chars follows the text."""
    out = line_dedup.drop_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of word shingles with similarity 0.8 stays."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to weights 5, 2, 1: every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digests of ids and decoded text."""
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"), keep_ids=True)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_copies),
          ("source_mix", mix_sources), ("bpe", encode_text)]

#: Word shingles, fitted profiles and token ids are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
