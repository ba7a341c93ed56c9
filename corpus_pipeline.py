"""The corpus pipeline: five stages over documents, each one operator of strandwise.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Where
the stages run one by one, each result is written as Parquet and reread; `run` does the same in the shared folder.

In all stages null texts are empty, repeated rows and rows of equal id and text are treated alike, and an empty table
gives an empty table. Stages return the columns that they get, in order; other columns than those of documents stay
and may have any name.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import bpe, decontaminate, language_id, line_dedup, simhash
from strandwise.llm.common import checkpoint, shared_folder, size_checked, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; text, declared language and source (as host) are the evidence.

    Texts that are null, empty or without letters have no language and go. Without a labelled row every document goes.
    """
    model = language_id.fit(docs)
    out = language_id.identify(docs, model, F.col("text"), F.col("lang"), F.col("source"))
    return out.where(language_id.accepted(F.col("language"), F.col("posterior"))).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of windows of three lines go; n_chars is that of the new text, 0 to many, null for a null text.

    Every row stays, also where no line is left. The first occurrence is that of the least id.
    """
    out = line_dedup.dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, a similarity of 0.8 or more."""
    return simhash.similar_representatives(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Documents without an id, and null texts, stay."""
    named = checkpoint(decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("doc_id")).distinct())
    return docs.join(size_checked(named, named.count()), "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to; none for a null text."""
    return bpe.encode_decode(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("decontaminate", leaks), ("bpe", tokens)]

#: SQL can't express trained language models, XXH64 fingerprints or byte-pair merges; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written in the shared folder and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
