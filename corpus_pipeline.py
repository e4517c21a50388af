"""Corpus pipeline: documents to packed training sequences, each stage written and read again.

toxicity and quality filters, near-duplicate removal, removal of repeated passages, packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from synthloom.llm.common import documents, held, stored, tokenizer_path
from synthloom.llm.minhash import near_duplicates
from synthloom.llm.packing import pack_documents
from synthloom.llm.quality import fit_quality, quality_score
from synthloom.llm.suffixes import strip_repeats
from synthloom.llm.toxicity import fit_toxicity, toxicity_score

THRESHOLD = 0.3          # as in the classifiers' own queries: from here on a text counts as toxic, or as good
SIMILARITY = 80          # per cent of shared five-word shingles from which on texts are near duplicates
PASSAGE_BYTES = 50
SEQUENCE_TOKENS = 2048


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, with all their columns.

    Null and empty texts are scored as one empty window; rows without an id and repeated rows are judged like others.
    """
    model = fit_toxicity(docs, documents(spark, sf_dir, "labels"), held("doc_id", 4) != 2)
    return docs.where(toxicity_score(model, F.col("text")) < THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject, with all their columns.

    Null and empty texts get the score of a text without words; rows without an id and repeated rows are judged like others.
    """
    model = fit_quality(docs, documents(spark, sf_dir, "labels"), held("doc_id", 5) != 0)
    return docs.where(quality_score(model, F.col("text")) >= THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, once, with all its columns.

    Documents without an id stay. Texts without words (null, empty) are nobody's duplicates; of rows that share an id
    and text one stays.
    """
    kept = near_duplicates(docs, SIMILARITY).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    same = W.partitionBy("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).orderBy("text")
    mark = "_copy"
    while mark in docs.columns:
        mark += "_"
    found = docs.join(kept, "doc_id", "left_semi").withColumn(mark, F.row_number().over(same)).where(F.col(mark) == 1)
    return found.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; all rows and columns stay.

    Null texts stay null. Of rows with equal text the one with the smallest id keeps it; see ``strip_repeats`` for rows without one.
    """
    return strip_repeats(docs, PASSAGE_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; a null text is empty, so its end id is its only token."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), SEQUENCE_TOKENS, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality", keep_quality), ("minhash", drop_near_duplicates),
    ("suffixes", drop_repeated_passages), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
