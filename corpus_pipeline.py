"""From raw documents to token ids: quality, exact copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet in the
shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivalgrid.llm import bpe, exact_dedup, mixture, ngram_join, quality
from rivalgrid.llm.common import read_table
from rivalgrid.session import cut_lineage, cuts, drop_tables, free_shuffles


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def stage(run_stage: Stage) -> Stage:
    """Tables that the stages before wrote on their way are deleted when a stage starts: what a stage returns
    is written before the next one reads it. Tables that ``docs`` is still read from stay."""

    @wraps(run_stage)
    def run_tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mine = _left.setdefault(spark.sparkContext.applicationId, [])
        read = docs.inputFiles()
        done = [t for t in mine if not any(t.rsplit("/", 1)[1] in f for f in read)]
        drop_tables(spark, done)
        mine[:] = [t for t in mine if t not in done]
        free_shuffles(spark)
        before = set(cuts(spark))
        out = run_stage(spark, docs, sf_dir)
        mine += [t for t in cuts(spark) if t not in before]
        return out

    return run_tidy


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their 5-word shingles."""
    return ngram_join.one_of_each(docs, words=5, percent=80)


@stage
def mixture_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixture.mixed_rows(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids, with the digest of what they decode to."""
    encoded, codec = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
        F.sha2(codec.decode(F.col("token_ids")), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture_of_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]

# SQL has no learnt classifier and no merges of byte pairs: the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = cut_lineage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
