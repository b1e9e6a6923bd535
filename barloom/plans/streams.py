"""Streaming queries, drained once over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import intraday as st
from . import tables as t
from .feeds import HEAD, NORM
from .indicators import show
from .oracle import HOURS, day, r, sql
from .registry import query


def ticks(spark, sf):
    """All events as one batch: files come in no order of time, and a watermark moves only between batches."""
    schema = t.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("seq"),
                    (F.col("user_id") % 5 + 1).cast("double").alias("size"))


@query("2.12.1", sql(f"SELECT symbol, {day('session')}, strftime(bar_ts, '%H:%M') AS bar, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, CAST(volume AS BIGINT) AS volume FROM hours", HOURS))
def stream_session_bars(spark, sf):
    b = st.run_once(st.bars(ticks(spark, sf)), ["symbol", "bar_ts"])
    b = b.withColumns({"session": F.to_date("bar_ts"), "bar": F.date_format("bar_ts", "HH:mm")})
    return show(b, "open", "high", "low", "close", "volume", keep=("symbol", "session", "bar"))


@query("2.12.2", f"""SELECT event_type AS symbol, {day('CAST(ts AS DATE)')}, {r('sum(value * (user_id % 5 + 1)) / sum(user_id % 5 + 1)', 'vwap')}, {r('sum(user_id % 5 + 1)', 'size')} FROM events GROUP BY event_type, CAST(ts AS DATE)""")
def stream_session_vwap(spark, sf):
    return show(st.run_once(st.session_vwap(ticks(spark, sf)), ["symbol", "session"]), "vwap", "size")


@query("2.12.4", sql(f"SELECT norm, count(*) AS kept FROM (SELECT DISTINCT {NORM} AS norm FROM hl) GROUP BY norm", HEAD))
def stream_distinct_stories(spark, sf):
    d = spark.readStream.schema(t.table(spark, sf, "documents").schema).parquet(f"{sf}/documents*.parquet")
    items = d.select(F.explode(F.split("text", "\n")).alias("title"), F.expr("timestamp'2026-01-01' + make_dt_interval(0, 0, 0, cast(doc_id as double) / 10)").alias("published_at"))
    return st.run_once(st.distinct_stories(items), mode="append").groupBy("norm").agg(F.count(F.lit(1)).alias("kept"))


@query("2.12.1 2.1.31", sql(f"SELECT symbol, {day('session')}, count(*) AS bars, {r('sum(close)', 'close_sum')} FROM hours GROUP BY symbol, session", HOURS))
def stream_upserted_sessions(spark, sf):
    """A stream of bars drives the upsert into a store by session; stale bars that lie there before are replaced."""
    import uuid

    from ..session import shared_folder
    path = f"{shared_folder(spark)}/barloom-store-{uuid.uuid4().hex}"
    stale = t.hour_bars(spark, sf).where("hour(bar_ts) < 6").withColumns({"close": F.lit(0.0), "volume": F.lit(0).cast("long")})
    st.upsert_sessions(path)(stale.select("symbol", "bar_ts", "open", "high", "low", "close", "volume", "session"), 0)
    st.keep_sessions(st.bars(ticks(spark, sf)), path, f"{path}__state")
    s = spark.read.parquet(path)
    return show(s.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("bars"), F.sum("close").alias("close_sum")), "bars", "close_sum")
