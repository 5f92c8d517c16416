"""The corpus pipeline: five stages over documents, each written and read by the next.

Every stage but the last returns the columns of documents. Each works on all that the one before
kept: the quality classifier drops texts that it scores below its threshold; of equal texts the row
with the largest doc_id stays; of each group of linked texts the smallest doc_id stays; texts that
hold a copy of a benchmark item go; what is left is encoded, and decoded as a proof.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescore.llm import decontamination, exact_dedup, ngram_join, quality_crf, sentencepiece_lattice
from tablescore.llm._exchange import stored
from tablescore.llm.queries import PIECE_MODEL, remainder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that score at least the threshold; learns from labels whose crc32 remainder (5) is not 0."""
    params = quality_crf.CrfParams()
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"), usable=remainder(5) != 0, params=params)
    return quality_crf.score_quality(docs, model, score="__quality").filter(F.col("__quality") >= params.threshold).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of linked texts."""
    groups = ngram_join.similar_components(docs)
    others = stored(groups.filter("component_id <> doc_id").select("doc_id"))
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that hold no copy of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with piece_ids, n_pieces and round_trip, whether decoding gives the text back;
    columns of those names are replaced."""
    vocabulary = sentencepiece_lattice.pieces(spark, PIECE_MODEL)
    decoded = sentencepiece_lattice.encode_and_decode(docs, vocabulary, ids="__ids", decoded="__decoded")
    same = F.col("__decoded") == F.coalesce("text", F.lit(""))
    found = {"piece_ids": F.col("__ids"), "n_pieces": F.size("__ids").cast("long"), "round_trip": same}
    return decoded.select(*(c for c in docs.columns if c not in found), *(x.alias(name) for name, x in found.items()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_copies),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL can't express the first, fourth and fifth stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
