"""The registered query of each operator, over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontamination, filter_audit
from barloom.llm.common import read
from barloom.llm.jaccard_join import jaccard_join
from barloom.llm.line_dedup import line_dedup
from barloom.llm.nearest import nearest
from barloom.llm.packing import pack
from barloom.llm.periodic_runs import periodic_runs
from barloom.llm.quality import quality
from barloom.llm.secrets import secret_scan
from barloom.llm.sharding import shard
from barloom.llm.suffix_tree import lm_scores
from barloom.llm.token_counts import token_counts
from barloom.llm.token_files import token_files


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token count of every document."""
    return token_counts(read(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest neighbours of every fiftieth vector, among all vectors."""
    return nearest(read(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, or are near, a line before."""
    return line_dedup(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_scan(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of full sequences."""
    return pack(read(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and suffix-tree score of every document."""
    return lm_scores(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality probability of every document."""
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_join(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shard and a slot for every document."""
    return shard(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters over all documents, by source."""
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as files with a shared dictionary and read back."""
    return token_files(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, with the repetitions that the contract plants."""
    return periodic_runs(read(spark, sf_dir, "documents"), planted=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_counts, op2_nearest, op3_decontamination, op4_line_dedup, op5_secret_scan, op6_packing, op7_lm_scores, op8_quality, op9_jaccard_join, op10_sharding,
    op11_filter_audit, op12_token_files, op13_periodic_runs,
)}
SQL: dict[str, str] = {"op3_decontamination": decontamination.SQL, "op11_filter_audit": filter_audit.SQL}
