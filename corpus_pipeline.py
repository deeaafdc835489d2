"""From raw documents to packed training sequences, each stage one operator for training data.

Every stage works on all that the one before it kept; its result is written as a table and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import linededup, mixing, neardup, packing, quality
from tracewright.llm.common import keep
from tracewright.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    scored = quality.score_documents(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 1).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that three or more documents share stay in one of them."""
    clean = linededup.dedup_lines(docs.select(COLUMNS))
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles: one document of each group stays."""
    return neardup.without_near_duplicates(docs.select(COLUMNS)).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every source comes near its target; a document comes up to three times."""
    docs = docs.select(COLUMNS)
    return mixing.repeat_mixed(docs, mixing.mix_sources(docs)).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: pieces of documents with their sequences and offsets."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), remember=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify), ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents), ("mix_sources", mix), ("best_fit_packing", pack)]

# Learned scores, signatures and tokenizers are beyond SQL; a brute-force version checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
