"""Small helpers shared by the operators: tables, tokenizer paths and the class graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.session import cut_lineage, shared_folder

__all__ = ["cut_lineage", "stored", "read", "tokenizer_path", "running_start", "components"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for tables with whole texts or token ids: compressed harder."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession).rstrip('/')}/barloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer file on the machine that calls this."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def running_start(df: DataFrame, key: str, order: str, size: str, bits: int = 9) -> DataFrame:
    """``start``: the sum of ``size`` over the rows of the same ``key`` with a smaller ``order``.

    ``order`` is unique in its key and well spread (a hash). Its values fall
    into ``2 ** bits`` ranges: sums run inside a range, and a second small window
    adds the totals of the ranges before it, so a key with most of the rows is
    still shared out to that many tasks.
    """
    b = df.withColumn("_b", F.shiftright(order, 64 - bits))
    total = b.groupBy(key, "_b").agg(F.sum(size).alias("_t"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = b.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return (out.join(total, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")))
            .withColumn("start", F.col("_base") + F.col("_in")).drop("_b", "_t", "_k", "_c", "_base", "_in"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's connected component: ``(node, root)``; nodes without an edge are left out.

    ``edges`` has the long columns u and v. Rounds of star contraction: every
    node hands its larger neighbours to its smallest one, then its smaller
    neighbours too. The edge list never grows, ends as one star for each
    component, and the loop stops when a round changes nothing. Each round is
    written to the shared folder.
    """
    pairs = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct())
    before = None
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        lowest = big.groupBy("v").agg(F.min("u").alias("m"))
        small = (big.join(lowest, "v").select(F.col("m").alias("u"), F.col("u").alias("v"))
                 .unionByName(lowest.select(F.col("m").alias("u"), "v")).where("u <> v").distinct())
        pairs = cut_lineage(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    root = pairs.groupBy("v").agg(F.min("u").alias("root"))
    return (root.select(F.col("v").alias("node"), "root")
            .unionByName(root.select(F.col("root").alias("node"), "root").distinct()))
