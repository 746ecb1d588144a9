"""Corpus cleaning: five stages, each on all that the stage before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it and
reads it back as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontamination, line_dedup, ngram_join, pieces, quality_classifier
from pathloom.plans.staging import discard, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; documents without anything else go whole."""
    kept = line_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8, stays."""
    return ngram_join.one_per_group(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontamination.without_documents(docs, _table(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether they decode to it."""
    coded = pieces.encode(docs.select("doc_id", "text"), decoded="decoded")
    return coded.select(
        "doc_id",
        "piece_ids",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding", piece_ids),
]

#: The classifier and the piece search are not SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES:
        given, docs = docs, stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(given)
    return docs
