"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import ratio
from ..session import shared_folder
from ..sources.news import normalise


def bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling bars per symbol; ticks later than the watermark of an earlier batch are dropped.

    ``ticks``: symbol, ts, value, seq (orders ticks of one instant).
    """
    at = F.struct("ts", "seq")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return g.select("symbol", F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def session_vwap(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """Value-weighted price of each symbol's session so far; late ticks as in ``bars``."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(
        F.sum(F.col("value") * F.col("size")).alias("pv"), F.sum("size").alias("v"))
    return g.select("symbol", F.to_date("w.start").alias("session"), ratio("pv", "v").alias("vwap"), F.col("v").alias("size"))


def distinct_stories(items: DataFrame, within_days: float = 30.0, late: str = "1 day", shelves: int = 16_384) -> DataFrame:
    """Items whose normalised title has not been seen in the ``within_days`` before; after that it is news again.

    The state of a title is when it was last let through. It is dropped once
    the watermark is past the time in which it could hold an item back, so titles
    that do not come again leave nothing behind. Items of a title that arrive
    together are taken by time, then by their other columns. Titles lie on
    ``shelves`` by their hash, since a call for each title would cost more than
    its work: the state of a shelf is its titles and their times, and a timer
    clears it when its last one is over.
    """
    named = items.withColumn("norm", normalise("title")).withColumn("__shelf", F.pmod(F.xxhash64("norm"), F.lit(shelves))).withWatermark("published_at", late)
    span = int(within_days * 86_400_000)
    order = ["published_at", *[c for c in items.columns if c != "published_at"]]

    def fresh(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentWatermarkMs()
        last = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(frames))
        if len(rows) > 1:
            rows = rows.sort_values(order, ignore_index=True)
        keep = []
        norms = [None if t is None or t != t else t for t in rows["norm"]]  # a null title is one title
        for k, (title, at) in enumerate(zip(norms, rows["published_at"].astype("datetime64[ms]").astype("int64").tolist())):
            seen = last.get(title)
            if seen is None or abs(at - seen) >= span:
                last[title] = at if seen is None else max(at, seen)
                keep.append(k)
        last = {t: at for t, at in last.items() if at + span > now}  # what the next batch brings is not older than this watermark
        if last:
            state.update((list(last.keys()), list(last.values())))
            state.setTimeoutTimestamp(max(max(last.values()) + span, now + 1))
        elif state.exists:
            state.remove()
        yield rows if len(keep) == len(rows) else rows.iloc[keep]

    kept = named.groupBy("__shelf").applyInPandasWithState(fresh, named.schema, "titles array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.drop("__shelf")


def upsert_sessions(path: str, keys: tuple[str, ...] = ("symbol",)):
    """foreachBatch sink: the rows of a batch replace the stored ones with their ``keys`` inside their sessions.

    Only the sessions the batch touches are read and rewritten. The merged rows
    are stored aside first, since a partition cannot be read while it is replaced;
    replaying a batch gives the same table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        aside = f"{path.rstrip('/')}__merge/{batch_id}"
        fresh = batch
        try:
            stored = spark.read.schema(batch.schema).parquet(path)
            touched = batch.select("session").distinct()
            kept = (stored.join(touched, "session", "left_semi")
                    .join(batch.select("session", *keys).distinct(), ["session", *keys], "left_anti"))
            fresh = kept.unionByName(batch)
        except Exception as e:  # first batch: nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(aside)
        (spark.read.schema(batch.schema).parquet(aside).repartition("session").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path))

    return write


def keep_sessions(bars: DataFrame, path: str, state: str) -> None:
    """Drive the upsert from a stream of bars until all that has arrived is stored.

    Every batch brings the bars that it changed; each replaces its earlier form.
    ``state`` holds the stream's progress: a restart goes on behind the last batch,
    and one that was cut off is done again.
    """
    rows = bars.withColumn("session", F.to_date("bar_ts"))
    q = (rows.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
         .foreachBatch(upsert_sessions(path, ("symbol", "bar_ts"))).start())
    q.awaitTermination()


def run_once(stream: DataFrame, keys: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Drain what is available and return the resulting table.

    Each batch lands in its own folder, overwritten on replay; with ``keys`` the
    newest batch wins per key. State and output live in the shared folder.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark).rstrip('/')}/barloom-stream-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).foreachBatch(land).start())
    q.awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
