"""One row that says what a day's scan looked at and what it leaves to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_plan(universe: DataFrame, features: DataFrame, scores: DataFrame, decided: DataFrame, as_of) -> DataFrame:
    """Counts per stage, the trades as an array, and why there are none.

    ``universe``: symbol, reason (stage 0); ``features``: one row per survivor;
    ``scores``: ranked names; ``decided``: symbol, rank, reason (NULL = approved).
    ``decided`` is the shortlist of one day, a few dozen rows.
    """
    u = universe.agg(F.count(F.lit(1)).alias("universe_scanned"), F.count_if(F.col("reason").isNull()).alias("survived_stage0"))
    ok = F.col("reason").isNull()
    d = decided.agg(F.struct(F.count(F.lit(1)).alias("analysed"), F.count_if(ok).alias("approved"),
                             F.array_sort(F.collect_list(F.when(ok, F.struct("rank", "symbol")))).alias("t")).alias("d")).scalar()
    why = (decided.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
           .agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason"))), 1, 3), lambda x: x["reason"]), ", ")).scalar())
    row = u.withColumns({"survived_stage1": features.agg(F.count(F.lit(1))).scalar(), "survived_stage2": scores.agg(F.count(F.lit(1))).scalar(),
                         "d": d}).select("*", "d.*")
    return row.select(F.lit(as_of).cast("date").alias("as_of"), "universe_scanned", "survived_stage0", "survived_stage1", "survived_stage2", "analysed", "approved",
                      F.array_join(F.transform("t", lambda x: x["symbol"]), ",").alias("trades"),
                      F.when(F.col("approved") == 0, F.concat(F.lit("NO TRADE - "), F.coalesce(why, F.lit("nothing qualified")))).alias("no_trade_reason"))
