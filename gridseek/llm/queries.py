"""One query for each operator, over whole tables, and the SQL that equals it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridseek.llm.common import table
from gridseek.llm.decontam import contamination
from gridseek.llm.linededup import line_deduplicated
from gridseek.llm.mixing import mixed
from gridseek.llm.neardup import near_duplicates
from gridseek.llm.oracle import SQL  # noqa: F401  read by the entry points
from gridseek.llm.pii import pseudonymized
from gridseek.llm.suffixdedup import without_repeats
from gridseek.llm.tokencount import token_counts
from gridseek.llm.topk import top_k
from gridseek.llm.toxicity import toxicity
from gridseek.llm.urlgraph import judged

#: A key of the queries here only; a real one comes from a secret store.
KEY = "a key for tests"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_found")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("source")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).drop("method")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_url_graph": op6_url_graph,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_top_k": op10_top_k,
}
