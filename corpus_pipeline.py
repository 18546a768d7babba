"""Corpus pipeline: the stages that turn raw documents into packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept; all but the last return
the columns of ``docs``.  Nulls in any column, empty and very long texts, repeated rows, extra columns and empty
tables pass through as the operators define them; documents without an id can't be duplicates and stay.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualitas.llm import best_fit_packing, mil_quality, pii_weak, superminhash
from qualitas.llm.queries import ACCEPT, BYTE_BPE, learnable
from qualitas.session import work_folder, written
from qualitas.sources.tables import table

#: Near-duplicate documents share this much of their shingles of so many words.
WORDS, PERCENT = 5, 80
CAPACITY, SEPARATOR = 2048, 0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that aren't held out."""
    return mil_quality.accepted(docs, mil_quality.train(docs, learnable(table(spark, sf_dir, "labels"))), ACCEPT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; repeated rows stay once.

    Different texts under one id are documents of their own.
    """
    classes = superminhash.near_duplicates(docs, words=WORDS, percent=PERCENT)
    kept = written(classes.where("first AND doc_id IS NOT NULL").select("doc_id", F.col("text_hash").alias("_text"))
                   .distinct(), work_folder(spark, "kept-texts"))
    rows = docs.where("doc_id IS NOT NULL").withColumn("_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    first = rows.join(kept, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"]).select(docs.columns)
    return first.unionByName(docs.where("doc_id IS NULL"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and their new lengths."""
    if "n_chars" not in docs.columns:
        raise ValueError("documents need the column n_chars, which is set to the masked texts' lengths")
    masked = pii_weak.mask(docs, pii_weak.train(pii_weak.vote_counts(docs)))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every piece of every document, with its place in a training sequence."""
    items = best_fit_packing.pieces(docs, BYTE_BPE, SEPARATOR, CAPACITY)
    return best_fit_packing.pack(items, CAPACITY)


STAGES = [("quality_classifier", keep_quality), ("near_dedup", drop_near_duplicates), ("pii", mask_personal_data),
          ("best_fit_packing", pack_sequences)]

#: The classifier, the masks and the packing aren't SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), work_folder(spark, name))
    return docs
