"""The corpus pipeline: documents through four of the training-data operators, each stage written and read by the next.

Near copies share four fifths of their five-word shingles (:data:`jaccard_join.CORPUS`); op6's contract binds op6 alone.
Every stage but the last returns the columns of documents. A document leaves if its language is rejected, if a near copy
with a smaller doc_id stays (of rows without one, or that repeat, one stays), or if it is contaminated by the benchmark; what is left is encoded, and decoded again.

Defined results
---------------
* null and letterless texts have no language and leave; a null lang is a document like others, but nothing is learned of it;
* a null doc_id: near copies leave all the same, and the other stages judge rows, not keys;
* rows that repeat are near copies of each other: one stays; an empty table passes all stages and gives an empty result;
* extra columns, whatever their names, go through all stages but the last;
* a stage's folder goes when the next one's is written, so that the last stage's input is what a run leaves behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, jaccard_join, langid, sentencepiece_scan
from tessella.llm.common import remove, shared_dir, table, tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, rule=jaccard_join.CORPUS)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    return sentencepiece_scan.digests(sentencepiece_scan.round_trip(docs, model))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

#: Language identification and segmentation are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
