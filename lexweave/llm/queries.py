"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, langid, lm, mixing, neardup, negatives, oracle, packing, quality, topk, trie, urls, warc
from .common import table


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.class_lm(table(spark, sf_dir, "documents"))


def op4_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(table(spark, sf_dir, "pages"))
    return records.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep_ids=False)


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(*trie.shared_openings(*trie.positions(table(spark, sf_dir, "conversations"))))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_neardup": op1_embedding_neardup,
        "op2_source_mix": op2_source_mix,
        "op3_class_lm": op3_class_lm,
        "op4_cover_topk": op4_cover_topk,
        "op5_warc_derivatives": op5_warc_derivatives,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_url_templates": op7_url_templates,
        "op8_language_id": op8_language_id,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_pu_quality": op10_pu_quality,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
