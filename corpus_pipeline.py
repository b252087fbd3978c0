"""A corpus pipeline: stages of (spark, docs, sf_dir) -> DataFrame, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavel.llm.common import Workspace, table
from gavel.llm.exact_dedup import drop_exact_copies
from gavel.llm.jaccard import keep_one_of_each
from gavel.llm.mixing import mixed_documents
from gavel.llm.packing import best_fit
from gavel.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; each row is judged by its text alone, a null text as an empty one."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest doc_id stays, a null doc_id last; of repeated rows one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 on five-word shingles the one with the smallest doc_id stays.

    Documents without words stay; rows that share a doc_id stay or go together.
    """
    return keep_one_of_each(docs, width=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: never, once or twice; one without words never.  A null source is one."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of each document in its bin; documents without words have none, copies avoid each other's bins."""
    return best_fit(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the stages; tests/llm/test_queries.py holds what each keeps against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after the other; an empty table goes through as any other."""
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir))
    return docs
