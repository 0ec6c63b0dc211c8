"""A training corpus from raw documents: quality rules, language, near duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next stage sees it. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import bpe, language, mixing, ngram_join, quality
from tidewatch.llm._shared import scratch_path


#: Languages that the corpus is to hold.
WANTED = ("de", "en", "es", "fr")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, repeated rows stay or go together, an empty table stays empty."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a wanted language and doesn't contradict its label.

    A label is no evidence for its own row. Null and unreadable texts go, null
    labels have nothing to contradict, null sources have no prior; without any
    label all rows stay; an empty table stays empty.
    """
    return language.keep(docs, WANTED)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Null texts and texts without words are like no other and stay, as do rows
    with a null doc_id; of repeated rows one stays; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, which may be never.

    Texts without words are never taken; a null source is a source of its own;
    repeated rows share what they are given; an empty table stays empty.
    """
    return mixing.repeated(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): token ids, and whether they decode to the text. Null texts count as empty, with no ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Trigram likelihoods, MinHash and BPE can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
