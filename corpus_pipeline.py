"""The training-data pipeline over documents: stages, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, neardup, pieces, quality
from lodestone.runtime import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE = 0.4  # of the letters, in the main language
SHINGLE, SIMILARITY = 5, 0.8  # words of a shingle; Jaccard similarity of near duplicates
#: Trained models and hashes can't be written in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_rules(docs).filter("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters, or no language with LEAST_SHARE of the letters."""
    found = langid.identify(docs, langid.train(docs), spans=False, keep=("text", "lang", "source", "n_chars"))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (SHINGLE words, SIMILARITY or more, verified on the texts) one row stays: that with the
    least id (no id comes last), of equal ids the least text hash."""
    return neardup.near_unique(docs.select(*COLUMNS), ("text", "source"), words=SHINGLE, threshold=SIMILARITY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated as the mix of sources takes them, and stand in the order of its slots."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, decoded again to see that nothing is lost."""
    return pieces.encode_with_check(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.split()[0].lower())
    return docs
