"""Registered queries of the training-data operators, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synthloom.llm.common import documents, held, tokenizer_path
from synthloom.llm.embeddings import embedding_duplicates
from synthloom.llm.fuzzyhash import fingerprint_edits
from synthloom.llm.minhash import near_duplicates
from synthloom.llm.packing import pack_documents
from synthloom.llm.pieces import sentence_pieces
from synthloom.llm.quality import score_quality
from synthloom.llm.search import ranked_search, search_sql
from synthloom.llm.suffixtree import suffix_tree_scores
from synthloom.llm.suffixes import suffix_dedup
from synthloom.llm.tokenshards import token_shards
from synthloom.llm.toxicity import score_toxicity
from synthloom.llm.trie import conversation_trie, trie_sql
from synthloom.llm.urlfilter import filter_urls, rule

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = held("doc_id", 4)
    return score_toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), rest != 2, rest == 2)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(documents(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), length=50)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = held("doc_id", 5)
    return score_quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), rest != 0, rest == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path(WORD_BPE), length=2048, end_id=1)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(documents(spark, sf_dir), tokenizer_path(WORD_BPE), end_id=2)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces(documents(spark, sf_dir), tokenizer_path(PIECE_BPE))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = held("doc_id", 10)
    return suffix_tree_scores(documents(spark, sf_dir), rest != 0, rest == 0)


URL_RULES = [rule("block", "net/"), rule("allow", "example.net/en/"), rule("block", "example.com/de/"), rule("allow", "org/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(documents(spark, sf_dir, "pages"), URL_RULES)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), k=50)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(documents(spark, sf_dir, "conversations"))


QUERIES = {"op1_toxicity": op1_toxicity, "op2_embedding_dedup": op2_embedding_dedup,
           "op3_suffix_dedup": op3_suffix_dedup, "op4_fingerprints": op4_fingerprints, "op5_quality": op5_quality,
           "op6_packing": op6_packing, "op7_minhash_dedup": op7_minhash_dedup, "op8_token_shards": op8_token_shards, "op9_pieces": op9_pieces,
           "op10_suffix_tree": op10_suffix_tree, "op11_url_filter": op11_url_filter, "op12_search": op12_search,
           "op13_conversation_trie": op13_conversation_trie}
SQL: dict[str, str] = {"op12_search": search_sql(50), "op13_conversation_trie": trie_sql()}
