"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, edit_counts, hnsw_dedup, html_consensus, jaccard_join, label_shards, langid, pfor_output, sentencepiece_scan, url_vocab
from tessella.llm.common import shared_dir, table, tokenizer_file


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    return sentencepiece_scan.digests(sentencepiece_scan.round_trip(table(spark, sf_dir, "documents"), model))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract_pages(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_shards.assign(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_vocab.filter_urls(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = tokenizer_file("byte_bpe_50k.tiktoken")
    kept = edit_counts.trees(docs.select("doc_id", "text"), ranks)
    return edit_counts.count(kept.withColumn("edits", edit_counts.trial_edits(F.col("text"))), ranks)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    files = pfor_output.write(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folder)
    return pfor_output.read(spark, folder, files, digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_html_extraction, op3_sharding, op4_url_filters, op5_benchmark_decontamination, op6_ngram_jaccard, op7_embedding_dedup, op8_language_id, op9_token_counts, op10_token_output)}
ORACLE_SQL: dict[str, str] = {"op4_url_filters": url_vocab.oracle(), "op5_benchmark_decontamination": decontaminate.ORACLE, "op6_ngram_jaccard": jaccard_join.ORACLE, "op7_embedding_dedup": hnsw_dedup.ORACLE}
