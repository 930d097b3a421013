"""The training-data pipeline: five stages over the documents table, each on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, fmindex, jaccard, substrings, toxicity
from tessera.llm.queries import vocabulary
from tessera.storage import materialize, scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored THRESHOLD or more go; the model learns from the labelled rows that op1 may learn from."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(docs).select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fmindex.remove_phrases(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, vocabulary())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", cut_benchmark),
    ("bpe", encode),
]
#: A trained classifier and a merge queue stand among the stages; tests/llm holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, as a written table; those of the stages before are deleted."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for k, (name, stage) in enumerate(STAGES):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=k == len(STAGES) - 1)
    return docs
