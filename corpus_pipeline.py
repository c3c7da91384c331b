"""A training-corpus pipeline over ``documents``: quality, near copies, repeated strings, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns rows with the columns of docs; only the last
returns the digests of token ids.  ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.byte_bpe import encode_decode
from feedloom.llm.common import put, table
from feedloom.llm.decontaminate import matched
from feedloom.llm.simhash import simhash_groups
from feedloom.llm.suffix_dedup import suffix_dedup
from feedloom.llm.weak_quality import weak_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier keeps."""
    return weak_quality(docs).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the document of the least id; documents without an id stay.  Rows of one id with different texts are judged
    apart."""
    others = simhash_groups(docs).where("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    return docs.withColumn("text_hash", F.xxhash64("text")).join(others, ["doc_id", "text_hash"], "left_anti").select(docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less their 50-byte strings that a document of a lesser id has; a character cut in part goes whole."""
    kept = suffix_dedup(docs, as_text=True).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is matched."""
    return matched(docs, table(spark, sf_dir, "benchmark")).where("size(matches) = 0").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids' number and digest, and the digest of the text they decode to."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_copies), ("suffix-array dedup", repeated_strings), ("benchmark decontamination", benchmark_leaks), ("byte-level BPE", tokens)]

#: XXH64 shingles, fitted models and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
