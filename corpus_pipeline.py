"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns a table that is written as Parquet and read again.
All stages but the last return the columns of ``documents``, whatever other
columns there are and however they are called. A null text counts as empty; very
long texts are read whole; repeated rows and null doc_ids are documents like
others; an empty table passes every stage as one.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.common import read, stored
from barloom.llm.decontamination import without_benchmark
from barloom.llm.jaccard_join import one_of_each
from barloom.llm.line_dedup import without_repeats
from barloom.llm.packing import pack
from barloom.llm.quality import THRESHOLD, fit, quality_scores


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null and empty texts have a score like any other."""
    scored = quality_scores(docs.select(F.struct("*").alias("doc"), "text"), fit(docs, read(spark, sf_dir, "labels")))
    return scored.where(F.col("quality_score") >= THRESHOLD).select("doc.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat, or are near, a line elsewhere before.

    Before means a smaller doc_id (null last), then the text's digest, then the
    place. Documents that this leaves without anything go; null, empty and blank
    texts stay as they are; repeated rows lose the same lines.
    """
    left = without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Equal texts and repeated rows are one group, null and empty texts among them.
    """
    return one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; texts without words hold none."""
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; a null or empty text is its closing id."""
    return pack(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", near_duplicate_stage),
          ("benchmark", benchmark_stage), ("packing", packing_stage)]
# the classifier, the edit join and the tokenizer are no SQL; tests compare the stages with brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
