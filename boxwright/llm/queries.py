"""The corpus queries: thin adapters from the given tables to the operators, and the SQL that some can be compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .alignment import aligned
from .compaction import compacted
from .decontamination import contaminated
from .html_text import extract_main_text
from .mixing import fit_mixture, labelled_documents, mixing_rates, with_totals
from .merkle import lowered_every_fifth, merkle_proofs
from .neardup import near_duplicates
from .packing import packed
from .pseudonyms import EXAMPLE_KEY, pseudonymise
from .quality import quality_verdicts
from .shared import Saved, read_table
from .sstable import read_shards, write_shards
from .tokens import LIMIT, prefix_counts
from .toxicity import toxicity, toxicity_model


def op1_tree_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_sstable_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read_table(spark, sf_dir, "documents")).df)


def op8_ngram_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1")
    return quality_verdicts(read_table(spark, sf_dir, "documents"), trusted)


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = Saved(prefix_counts(read_table(spark, sf_dir, "documents"), packed=True).drop("n_tokens"), "prefixes").df
    n_tokens = F.aggregate("counts", F.lit(0), lambda a, b: a + b).cast("long")  # the last count: the sum of the differences
    return stored.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > LIMIT).alias("over_limit"))


def op4_gradient_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mixture = fit_mixture(docs, labelled_documents(docs, read_table(spark, sf_dir, "labels")))
    return with_totals(mixing_rates(mixture), mixture)


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, toxicity_model(docs, read_table(spark, sf_dir, "labels")))


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"), EXAMPLE_KEY)


def op10_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted(read_table(spark, sf_dir, "documents"), arrivals=3).located()


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_proofs(read_table(spark, sf_dir, "documents"), lowered_every_fifth())


def op12_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_tree_html_text": op1_tree_html_text,
    "op2_minhash_neardup": op2_minhash_neardup,
    "op3_prefix_token_counts": op3_prefix_token_counts,
    "op4_gradient_mixing": op4_gradient_mixing,
    "op5_cgk_decontamination": op5_cgk_decontamination,
    "op6_nnpu_toxicity": op6_nnpu_toxicity,
    "op7_sstable_token_shards": op7_sstable_token_shards,
    "op8_ngram_llr_quality": op8_ngram_llr_quality,
    "op9_feistel_pseudonyms": op9_feistel_pseudonyms,
    "op10_tiered_compaction": op10_tiered_compaction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_best_two_fit_packing": op12_best_two_fit_packing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {"op2_minhash_neardup": oracles.NEAR_DUPLICATES, "op11_merkle_manifest": oracles.merkle()}
