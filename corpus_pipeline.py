"""Corpus pipeline: documents to packed training sequences, one operator a stage.

Every stage works on all that the stage before kept. All but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boursecraft.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from boursecraft.llm.queries import held_out
from boursecraft.llm.registry import table
from boursecraft.session import materialise


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half, by a lexicon trained on the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the largest identifier."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the smallest identifier."""
    return near_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and their n_chars counted again."""
    # the row as it was travels in a struct: no column of the documents can be mistaken for another
    carried = docs.select(F.col("doc_id"), F.col("text"), F.struct(*docs.columns).alias("row"))
    clean = secret_scan.redact(carried, secret_scan.train(docs))
    same = F.col("text").eqNullSafe(F.col("row.text"))
    fresh = {"text": F.col("text"), "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))}
    return clean.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)
    return packing.pack(parts, capacity=2048).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("minhash near-dedup", near),
    ("secret scans", secrets),
    ("best-fit packing", packed),
]

#: Trained scores, near-duplicate links and tokens have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is stored and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
