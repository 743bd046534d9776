"""Toxicity, near duplicates, benchmark leaks, mixing, token files: one pass
over the documents, each stage written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sleuthframe.llm.common import shared_folder, table, written
from sleuthframe.llm.decontamination import without_items
from sleuthframe.llm.mixing import training_documents
from sleuthframe.llm.ngram_join import one_of_each
from sleuthframe.llm.token_files import read_token_files, row_order, write_token_files
from sleuthframe.llm.toxicity import learn, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often, and in the order, that the sources' weights ask."""
    return training_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in its order as files of token ids; a row per document read back."""
    return read_token_files(write_token_files(docs, shared_folder(spark), order=row_order(docs)))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]
#: A learned score decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{folder}/{k}")
    return docs
