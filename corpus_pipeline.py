"""A corpus pipeline of five stages, each of which works on all that its predecessor kept.

quality rules: documents that the rules reject go. exact dedup: of equal texts the smallest id stays. n-gram Jaccard join: of
each component of near copies (shingles of NEAR_WIDTH words, similarity of NEAR_PER / 100 or more) the smallest id stays. mixing: rows in training order, each as often as its source's target
takes it (an id may then stand in several rows, or in none where a source exceeds its target). pieces: every row's best
segmentation and the scores of the n best; its columns are those of encode_nbest().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm.common import saved
from keyloom.llm.exact_dedup import without_copies
from keyloom.llm.jaccard_trie import without_near_copies
from keyloom.llm.mixing import mixed_rows
from keyloom.llm.quality_rules import passing
from keyloom.llm.sp_nbest import encode_nbest

#: Near copies of the pipeline. op10_jaccard_trie has figures of its own, which its SQL names.
NEAR_WIDTH, NEAR_PER = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passing(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs, width=NEAR_WIDTH, per=NEAR_PER)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_nbest(docs)


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("n-gram jaccard join", near_stage), ("source mixing", mixing_stage), ("sentencepiece", pieces_stage)]

#: SentencePiece lattices and numeric hashes aren't expressible in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
