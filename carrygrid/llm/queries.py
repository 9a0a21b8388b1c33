"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carrygrid.llm import (
    dialogue, gumbel, html_text, importance, language, near_dup, packing, passages, quality, token_counts, toxicity, vectors, winnowing,
)
from carrygrid.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages: who loses which bytes, and which document keeps them."""
    return passages.repeats(spark, table(spark, sf_dir, "documents"))


def op2_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op3_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_gumbel_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of each document, sampled without replacement."""
    return gumbel.digest(table(spark, sf_dir, "documents"))


def op5_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark, table(spark, sf_dir, "embeddings"))


def op6_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, table(spark, sf_dir, "pages"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(spark, table(spark, sf_dir, "documents"))


def op8_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op11_path_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of each damaged conversation."""
    return dialogue.report(spark, table(spark, sf_dir, "conversations"))


def op12_crc_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark texts."""
    return importance.report(spark, sf_dir)


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_paragraph_minhash": op1_paragraph_minhash,
    "op2_minhash_bayes": op2_minhash_bayes,
    "op3_ngram_ratio": op3_ngram_ratio,
    "op4_gumbel_topk": op4_gumbel_topk,
    "op5_subspace_join": op5_subspace_join,
    "op6_template_removal": op6_template_removal,
    "op7_best_fit": op7_best_fit,
    "op8_hyperdimensional": op8_hyperdimensional,
    "op9_counterfactual_toxicity": op9_counterfactual_toxicity,
    "op10_trie_counts": op10_trie_counts,
    "op11_path_ranking": op11_path_ranking,
    "op12_crc_matrices": op12_crc_matrices,
    "op13_winnowing": op13_winnowing,
}

# For the others, whose hashes, learned scores or searches SQL cannot express, tests/llm has brute force.
ORACLE: dict[str, str] = {"op3_ngram_ratio": quality.ORACLE, "op11_path_ranking": dialogue.ORACLE, "op12_crc_matrices": importance.ORACLE}
