"""Documents to packed training sequences: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the
last return the columns of the documents they are given; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm import block_repeats, near_dedup, packing, quality
from tallylog.llm.queries import TOKENIZER, public_tokenizers
from tallylog.llm.shared import fresh_folder, remove_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps."""
    return quality.keep_good(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the least id, of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def substring_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand anywhere else; n_chars is that of the text left."""
    kept = block_repeats.remove_repeats(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as pieces of sequences of 2048."""
    return packing.pack_documents(docs, TOKENIZER, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_deduplication),
    ("substring dedup", substring_deduplication),
    ("best-fit packing", best_fit_packing),
]

#: The quality model, the components and the packing have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What a stage keeps is written to the shared folder, as the
    next one reads it several times; the last stage holds its own pieces, so the folders go."""
    docs, folders = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        folders.append(fresh_folder(spark, name.replace(" ", "-")))
        stage(spark, docs, sf_dir).write.parquet(folders[-1])
        docs = spark.read.parquet(folders[-1])
    packed = STAGES[-1][1](spark, docs, sf_dir)
    for folder in folders:
        remove_folder(spark, folder)
    return packed
