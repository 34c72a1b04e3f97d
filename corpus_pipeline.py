"""The corpus pipeline: quality, near copies, benchmark leaks, mixing, packing.

Each stage takes the documents that its predecessor kept and works on all of
them. All but the last return the columns of documents; mixing returns a row
for each copy, in shuffled order.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and further columns, and returns no rows for an empty table. What a stage does
with them is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import decontaminate, minmax_dedup, mixing, packing, pu_quality
from trialframe.llm.helpers import checkpointed, held_out, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the positive-unlabelled classifier rejects.

    Null and empty texts are scored like any other; without trusted labels all
    scores are 0.5 and all documents stay."""
    labels = table(spark, sf_dir, "labels")
    trusted = labels.where(~held_out(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
    return pu_quality.score(docs, trusted, out_col="__score").where("__score >= 0.5").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Texts without words link with nothing and stay, as do rows with a null id;
    rows that repeat an id are one document and stay or go together."""
    found = minmax_dedup.find(docs, percent=80, shingle=5, bands=38, rows=5)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__id"))
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, re-parameterised or not.

    Null and empty texts stay; rows with one id (null too) are one document."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal weight for every source, as many rows as before on average.

    A null source is a source; repeated rows are drawn alike."""
    return mixing.replicate(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids. Texts that are null or empty have no tokens and are in no row."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("leaks", leaks), ("mixture", mixture), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result cut off in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
