"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.decontamination import contaminated
from boxwright.llm.mixing import fit_mixture, forget, labelled_documents, mixed_documents
from boxwright.llm.neardup import near_duplicates
from boxwright.llm.shared import Saved, kept, read_table, scratch, small_side
from boxwright.llm.sstable import read_shards, write_shards
from boxwright.llm.toxicity import PREDICTED_FROM, accepted, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go; it learns from the labels of these documents.

    Null and empty texts have no features and stay; each row, repeated or without an identifier, is judged by its text.
    """
    return accepted(docs, toxicity_model(docs, read_table(spark, sf_dir, "labels")), PREDICTED_FROM)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least identifier stays, and one of the rows that repeat it.

    Rows that repeat an identifier must repeat its text to be one document; other texts under it stay or go with it.
    Rows without an identifier are compared with each other by whole texts only. Null and blank texts stay.
    """
    gone = Saved(near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "duplicates")
    left = docs.join(small_side(gone.df), "doc_id", "left_anti").select(*docs.columns)
    repeated = Saved(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated")
    if repeated.df.isEmpty():
        return left
    again = repeated.df.select(F.col("doc_id").alias("id"))
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    # the texts of repeated identifiers alone are shuffled
    return left.join(small_side(again), same, "left_anti").unionByName(left.join(small_side(again), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, exact or slightly edited, go.

    All rows under a contaminated identifier go, those without one among themselves. Null and empty texts hold nothing.
    """
    leaks = Saved(contaminated(docs, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id")), "leaks")
    return docs.join(small_side(leaks.df), F.col("doc_id").eqNullSafe(F.col("id")), "left_anti")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that domains have their share of tokens.

    Null and empty texts have the rate of a text without features; repeated rows are drawn alike.
    """
    mixture = fit_mixture(docs, labelled_documents(docs, read_table(spark, sf_dir, "labels")))
    forget(mixture)
    return mixed_documents(docs, mixture)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sorted shards, read back: doc_id, start, n_tokens, ids_crc32; null texts hold the end id alone."""
    return read_shards(write_shards(docs).df)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
    ("token_shards", write_token_shards),
]
#: Trained classifiers, a tokenizer and edit distances are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written as Parquet and read again as the next one's documents."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):  # what a stage writes for itself goes with it
            out = kept(Saved(stage(spark, docs, sf_dir), f"stage-{name}"))
        if last:
            last.drop()
        docs, last = out.df, out
    return docs
