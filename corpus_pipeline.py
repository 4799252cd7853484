"""From raw documents to piece ids: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``; ``n_chars``
follows the text where a stage changes it.

Cases: rows of null or empty text fail the quality rules; null sources are a source of their own;
repeated rows are near copies of each other; an empty table passes through as an empty result; other
columns of the documents are left out at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import mixing, quality, sentence_pieces, shingle_pairs, site_lines
from barflow.llm.common import word_count
from barflow.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others stay as they are."""
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go from the texts."""
    return site_lines.drop_boilerplate(docs).withColumn(
        "n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the 5-word shingles) stays, that of the smallest id: SimHash
    fingerprints of the shingles name candidates, checked exactly; an exact join adds what they miss."""
    return shingle_pairs.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them, none to twice."""
    return mixing.emit(mixing.mix(docs, word_count("text"), text_hash=F.col("text")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, N-best scores and what each of the N segmentations changes, of each document taken."""
    done = sentence_pieces.encode(docs.select(
        F.struct("doc_id", "lang", "source", "n_chars").alias("doc"), "text"), id_col="doc")
    return done.select("id.*", F.size("pieces").alias("n_pieces"), "pieces",
                       F.col("scores").alias("n_best_scores"), "round_trip",
                       F.col("changes").alias("n_best_changes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: The last stage's N-best search has no SQL; the tests hold the result against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
