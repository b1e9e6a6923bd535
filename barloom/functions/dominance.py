"""How many earlier values are no larger: counts over two orders at once, without a list per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

LEVELS = 24


def count_not_above(df: DataFrame, at: str, value: str, out: str = "not_above", levels: int = LEVELS) -> DataFrame:
    """``out``: of the rows up to and with this one (order ``at``, unique), those whose ``value`` is not above its own.

    Values become ranks, and a rank is read bit by bit. Of two ranks that agree
    above a bit the one without it is smaller, so a row that has the bit counts
    the earlier rows that agree with it above and lack it: a running sum within
    (bit, upper bits). Summed over the bits these are the smaller values, and
    equal ones are counted apart. Every row appears once a bit, so the table
    grows by a factor, not with its own length. Null values count nowhere and get
    null. Up to 2 ** ``levels`` distinct values.
    """
    ranked = df.where(F.col(value).isNotNull()).select(F.col(at).alias("__at"), (F.dense_rank().over(Window.orderBy(value)) - 1).cast("long").alias("__r"))
    bits = ranked.select("__at", "__r", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("__l"))
    bits = bits.select("__at", "__l", F.expr("shiftright(__r, __l + 1)").alias("__up"), F.expr("shiftright(__r, __l) & 1").alias("__bit"))
    earlier = Window.partitionBy("__l", "__up").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    lower = (bits.withColumn("__n", F.sum(1 - F.col("__bit")).over(earlier)).groupBy("__at")
             .agg(F.sum(F.col("__n") * F.col("__bit")).alias("__lower")))
    equal = ranked.select("__at", F.count(F.lit(1)).over(Window.partitionBy("__r").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)).alias("__equal"))
    counts = lower.join(equal, "__at").select(F.col("__at"), (F.col("__lower") + F.col("__equal")).alias(out))
    return df.join(counts, F.col(at) == F.col("__at"), "left").drop("__at")
