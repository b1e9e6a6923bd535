"""Exact percentile ranks of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage


def group_rank_pct(df: DataFrame, keys: list[str], value: str, out: str = "rank_pct",
                   buckets: int = 64, scale: float = 1.0) -> DataFrame:
    """Average rank of ties, times ``scale``, over the count of values, within ``keys``.

    Rows are first reduced to (keys, value, n), so a tie shared by a third of
    the table is one row. Approximate quantiles then cut each group into value
    ranges; ranks are counted inside a range and shifted by the exact number of
    rows in lower ranges. The cut points only steer where work lands: any cut
    gives the same ranks. They are stored, since they depend on the order in
    which partial results meet, and counts and ranks need the same ones. No task
    ever holds a whole group.
    """
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")))
    share = [i / buckets for i in range(1, buckets)]
    cuts = cut_lineage(counts.groupBy(*keys).agg(
        F.percentile_approx(value, share, 1000).alias("__cuts")))
    binned = (counts.join(cuts, keys)
              .withColumn("__b", F.size(F.filter("__cuts", lambda c: c < F.col(value))))
              .drop("__cuts"))
    per_bin = binned.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
    below = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select(*keys, "__b",
                             F.coalesce(F.sum("__bn").over(below), F.lit(0)).alias("__off"),
                             F.sum("__bn").over(Window.partitionBy(*keys)).alias("__tot"))
    inside = (Window.partitionBy(*keys, "__b").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    ranks = (binned.withColumn("__cum", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
             .join(offsets, keys + ["__b"])
             .select(*keys, value,
                     (scale * (F.col("__off") + F.col("__cum") + (F.col("__n") + 1) / 2)
                      / F.col("__tot")).alias(out)))
    return df.join(ranks, keys + [value], "left")
