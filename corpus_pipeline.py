"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import decontam, pii, simhash, spm, toxicity
from newsloom.llm.common import read_table, stored
from newsloom.llm.queries import HELD_OUT, PIECE_MODEL, TOXIC_SCORE


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text again after a stage that rewrites texts."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches TOXIC_SCORE go."""
    return toxicity.remove_toxic(docs, read_table(spark, sf_dir, "labels"), ~F.expr(HELD_OUT), TOXIC_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (3-word shingles, 2 bits) stays: the one with the smallest id."""
    return simhash.keep_one_per_group(docs, k=3, max_bits=2)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark passages (10-word windows) are cut; a document with over half its words hit goes."""
    return _counted(decontam.remove_contamination(docs, read_table(spark, sf_dir, "benchmark"), 10, 0.5))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emails, ip addresses, card and phone numbers, disguised ones included, become <EMAIL>, <IP>, <CARD>, <PHONE>."""
    return _counted(pii.mask_pii(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every kept document, without its text, and whether they decode to it."""
    encoded = spm.encode_documents(docs, public_tokenizers.path(PIECE_MODEL), verify_col="round_trip")
    return encoded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "round_trip")


STAGES = [
    ("toxicity", toxic),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", contaminated),
    ("pii", personal_data),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # model scores, checked patterns and piece ids are beyond SQL; tests compare with brute force
