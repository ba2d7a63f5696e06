"""One query per operator, with production parameters, over the whole input table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.llm import (decontaminate, html_text, minhash_dedup, neighbours, packing, pii, prefix_trie, quality,
                           set_join, sharding, toxicity, url_filter, vector_codes)
from paneltide.llm.oracle import (OP4_DECONTAMINATE, OP8_MINHASH_DEDUP, OP11_SET_JOIN, OP12_VECTOR_CODES,
                                   OP13_PREFIX_TRIE)
from paneltide.llm.tables import table

URL_BLOCK = ("net/", "example.com/de/")
URL_ALLOW = ("example.net/en/", "org/fr/")
SHARDS = 40
TOKENIZER = packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("byte_bpe_50k.tiktoken"),
                               public_tokenizers.PATTERN)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]),
                              F.col("vec_id") % 20 == 0, k=20)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages", ["page_id", "url"]),
                                 URL_BLOCK, URL_ALLOW)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                   table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                       table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                    [1.0] * SHARDS, grown_weight=1.0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", ["doc_id", "text"]), TOKENIZER)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                 table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents", ["doc_id", "text"])).drop("text_key")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages", ["page_id", "url", "html"]))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.jaccard_components(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_html_text": op9_html_text,
    "op10_pii": op10_pii,
    "op11_set_join": op11_set_join,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

# SQL counterparts; none where DuckDB lacks a function (CRC-32, tokens) or SQL a model.
ORACLE: dict[str, str] = {
    "op4_decontaminate": OP4_DECONTAMINATE,
    "op8_minhash_dedup": OP8_MINHASH_DEDUP,
    "op11_set_join": OP11_SET_JOIN,
    "op12_vector_codes": OP12_VECTOR_CODES,
    "op13_prefix_trie": OP13_PREFIX_TRIE,
}
