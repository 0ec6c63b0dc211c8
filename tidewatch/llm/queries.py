"""The queries of this folder: one per operator, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from tidewatch.llm import ann, bpe, huffman, kd_shards, language, mixing, ngram_join, quality, token_counts, url_filter
from tidewatch.llm._shared import table

QUERIES = {
    "op4_token_counts": lambda spark, d: token_counts.query(table(spark, d, "documents")),
    "op1_balanced_lists": lambda spark, d: ann.query(table(spark, d, "embeddings")),
    "op2_ngram_join": lambda spark, d: ngram_join.query(table(spark, d, "documents")),
    "op8_language_id": lambda spark, d: language.query(spark, table(spark, d, "documents"), table(spark, d, "pages")),
    "op7_kd_shards": lambda spark, d: kd_shards.query(table(spark, d, "documents")),
    "op3_huffman_ids": lambda spark, d: huffman.query(table(spark, d, "documents")),
    "op5_byte_bpe": lambda spark, d: bpe.query(table(spark, d, "documents")),
    "op6_quality_rules": lambda spark, d: quality.query(table(spark, d, "documents")),
    "op9_source_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op10_url_filter": lambda spark, d: url_filter.query(table(spark, d, "pages")),
}

ORACLES = {"op6_quality_rules": quality.SQL, "op10_url_filter": url_filter.SQL}
