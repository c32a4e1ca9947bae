"""A training corpus from ``documents``: five stages, each of which works on all that the one before kept.

1. quality classifier: documents that it rejects go;
2. language identification: documents that fit no language go;
3. n-gram Jaccard join: one document of each group of near copies stays (five-word shingles, similarity 0.8);
4. mixing: each source is taken to its target, documents once, twice or not at all;
5. byte-level BPE: the token ids of every document.

All stages but the last return the columns of their input; the last returns
doc_id, n_tokens, ids_sha256, decoded_sha256 and ids. Null, empty and repeated
rows, null ids and empty tables are treated as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bpe, jaccard, langid, mixing, quality
from lexweave.llm.common import cut, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts 1 for; a null text is an empty one."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fit one of the labelled languages; texts without a letter go."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; documents without words and rows without id stay."""
    return jaccard.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, one row for each copy; the text itself goes."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("languages", keep_languages),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("tokens", tokenize),
]
#: SQL can't express the trained stages. Tests hold the operators against brute force, not yet run() itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
