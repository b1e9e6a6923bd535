"""Forward events: price-moving test, holding-window block, coverage, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import base_symbol, col, truth

# Words that mark an event as price-moving.
MOVING_WORDS = ("result", "financial", "earning", "dividend", "bonus", "split",
                "buyback", "buy back", "rights", "merger", "amalgamat", "demerger",
                "fund rais", "fundrais", "preferential", "stock option")


def is_price_moving(*text) -> Column:
    return F.lower(F.concat_ws(" ", *[col(c) for c in text])).rlike("|".join(MOVING_WORDS))


def next_event(asks: DataFrame, events: DataFrame, moving_only: bool = True) -> DataFrame:
    """First event on or after each (symbol, as_of).

    Both sides reduce to one row per symbol and day before they share a time
    order, and the next event is carried back; the answer then joins the
    questions on (symbol, as_of). ``known`` is false when the calendar has no
    entry for the symbol at all.
    """
    e = (events.where("moving") if moving_only else events).groupBy("symbol", "event_date").agg(F.min("purpose").alias("purpose"))
    marks = (e.select("symbol", F.col("event_date").alias("at"), F.lit(1).alias("k"), F.col("event_date").alias("ev"), "purpose")
             .unionByName(asks.select("symbol", F.col("as_of").alias("at"), F.lit(0).alias("k"), F.lit(None).cast("date").alias("ev"),
                                      F.lit(None).cast("string").alias("purpose")).distinct()))
    w = Window.partitionBy("symbol").orderBy("at", "k").rowsBetween(0, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("k") == 1, F.struct("ev", "purpose")), ignorenulls=True).over(w)
    found = marks.withColumn("n", nxt).where("k = 0").select("symbol", F.col("at").alias("as_of"), "n")
    known = events.select("symbol", F.lit(True).alias("known")).distinct()
    return (asks.join(found, ["symbol", "as_of"]).join(known, "symbol", "left").select(
        "symbol", "as_of", "ask", F.col("n.ev").alias("event_date"), F.col("n.purpose").alias("purpose"),
        F.datediff("n.ev", "as_of").alias("days_until"), truth(F.col("known")).alias("known")))


def blocks(holding_days: int) -> Column:
    return truth((F.col("days_until") >= 0) & (F.col("days_until") <= holding_days))


def coverage(asked: DataFrame, events: DataFrame) -> DataFrame:
    """(names the calendar knows, names asked about)."""
    known = events.select(base_symbol("symbol").alias("b")).distinct().withColumn("hit", F.lit(1))
    return asked.select(base_symbol("symbol").alias("b")).join(known, "b", "left").agg(
        F.count("hit").alias("known"), F.count(F.lit(1)).alias("asked"))


def fresh_snapshot(fetched="fetched_at", as_of="as_of", max_age: int = 3) -> Column:
    """A snapshot from the future is look-ahead and as unusable as a stale one."""
    age = F.datediff(col(as_of), col(fetched))
    return truth((age >= 0) & (age <= max_age))


def fresh_news(fetched="fetched_at", now="now", max_hours: float = 18.0) -> Column:
    age = (F.unix_timestamp(col(now)) - F.unix_timestamp(col(fetched))) / 3600.0
    return truth((age >= -1.0) & (age <= max_hours))
