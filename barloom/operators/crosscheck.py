"""Two sources of the same instruments, matched through their identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import base_symbol


class JoinError(ValueError):
    """The right side repeats a key that must be unique."""


def bucketed(left: DataFrame, right: DataFrame, ids: DataFrame, min_turnover: float = 1e7) -> DataFrame:
    """Every left row with the bucket it falls in; the buckets add up to all rows.

    ``ids``: base, isin, ambiguous. A (isin, session) that repeats on the right
    raises when the result is read; the check rides on the aggregation that
    readies the right side.
    """
    one = right.groupBy("isin", "session").agg(F.count(F.lit(1)).alias("__n"), F.first("close").alias("ref_close"),
                                               F.first("turnover").alias("ref_turnover"))
    ok = F.assert_true(F.col("__n") == 1, F.lit("identifier repeats on one session, the join is ambiguous"))
    one = one.withColumn("__ok", ok)
    l = left.select("symbol", "session", "close", base_symbol("symbol").alias("base")).join(ids, "base", "left")
    keyed = F.when(~F.coalesce("ambiguous", F.lit(False)), F.col("isin"))
    j = l.withColumn("isin", keyed).join(one, ["isin", "session"], "left")
    bucket = (F.when(F.coalesce("ambiguous", F.lit(False)), "ambiguous_isin").when(F.col("isin").isNull(), "no_isin")
              .when(F.col("ref_close").isNull(), "not_on_other").when(F.coalesce("ref_turnover", F.lit(0.0)) < min_turnover, "thin")
              .when(F.col("ref_close") <= 0, "no_usable_close").otherwise("checkable"))
    return j.where(F.col("__ok").isNull()).select("symbol", "session", "close", "ref_close", "ref_turnover", bucket.alias("bucket"))


def bucket_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))


def reconcile(rows: DataFrame, tolerance_pct: float = 2.0) -> DataFrame:
    """Checkable closes that differ by more than the tolerance, widest first."""
    d = rows.where("bucket = 'checkable'").withColumn("diff_pct", F.abs(F.col("close") - F.col("ref_close")) / F.col("ref_close") * 100.0)
    return d.where(F.col("diff_pct") > tolerance_pct).orderBy(F.desc("diff_pct"), "symbol", "session")
