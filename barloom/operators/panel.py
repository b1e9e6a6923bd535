"""Panel scans: point-in-time history, re-windowing, dedup, coverage, densify."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import truth
from ..schemas import require_columns

# Fixed value: the mainstream cash-equity series.
EQUITY_SERIES = ("EQ",)


class PanelError(ValueError):
    """The panel cannot answer honestly; absence of rows is never this error."""


def sessions_of(bars: DataFrame, session: str = "session") -> DataFrame:
    """Distinct sessions; on a partition column this reads no data pages."""
    return bars.select(session).distinct()


def available_days(bars: DataFrame) -> DataFrame:
    return sessions_of(bars).orderBy("session")


def index_sessions(bars: DataFrame, sessions: DataFrame | None = None,
                   at: str = "idx") -> DataFrame:
    """Attach the position of each session in the panel's own calendar.

    The calendar holds one row per session however many symbols trade, so it is
    numbered in one task. How it is joined is left to the optimizer, which knows
    its size.
    """
    cal = (sessions if sessions is not None else sessions_of(bars)).select("session")
    cal = cal.withColumn(at, F.row_number().over(Window.orderBy("session")) - 1)
    return bars.join(cal, "session")


def last_session(bars: DataFrame, as_of=None):
    """Scalar subquery: the newest session at or before ``as_of``."""
    days = bars.select("session")
    if as_of is not None:
        days = days.where(F.col("session") <= F.lit(as_of).cast("date"))
    return days.agg(F.max("session")).scalar()


def history(bars: DataFrame, as_of, lookback: int | None = None, start=None,
            symbols=None, columns=None) -> DataFrame:
    """Bars up to ``as_of``; ``lookback`` counts sessions present in the store.

    The session filter is on the partition column and the symbol filter and
    projection reach the parquet scan.
    """
    if lookback is not None and start is not None:
        raise PanelError("a window begins either at a day or a number of sessions back")
    if lookback is not None and lookback < 1:
        raise PanelError(f"a window of {lookback} sessions is empty")
    out = bars.where(F.col("session") <= F.lit(as_of).cast("date"))
    if start is not None:
        out = out.where(F.col("session") >= F.lit(start).cast("date"))
    if lookback is not None:
        newest = sessions_of(out).orderBy(F.desc("session")).limit(lookback)
        out = out.where(F.col("session") >= newest.agg(F.min("session")).scalar())
    if symbols is not None:
        out = out.where(F.col("symbol").isin(list(symbols)))
    if columns is not None:
        out = out.select(*dict.fromkeys(["symbol", "session", *columns]))
    return out


def load_day(bars: DataFrame, day) -> DataFrame:
    """One session. A day the store does not hold is an error, raised when read."""
    one = bars.where(F.col("session") == F.lit(day).cast("date"))
    guard = one.limit(1).agg(F.assert_true(F.count(F.lit(1)) > 0,
                                           F.lit(f"no snapshot for {day}")).alias("ok"))
    return one.where(guard.scalar().isNull())


def series_of(bars: DataFrame, symbol: str) -> DataFrame:
    return bars.where(F.col("symbol") == symbol).orderBy("session")


def partition_guard(bars: DataFrame, partition: str, content: str) -> DataFrame:
    """Partitions whose rows carry a date other than the partition's own."""
    return (bars.groupBy(partition)
            .agg(F.min(content).alias("first_day"), F.max(content).alias("last_day"),
                 F.count(F.lit(1)).alias("rows"))
            .withColumn("agrees", truth((F.col("first_day") == F.col(partition))
                                        & (F.col("last_day") == F.col(partition)))))


def resolve_series(bars: DataFrame, prefer=EQUITY_SERIES) -> DataFrame:
    """One instrument per (session, symbol): a preferred series wins.

    Among equals the lowest series label wins, so the result does not depend on
    row order. ``min_by`` over a struct keeps this one partial aggregation.
    """
    rest = [c for c in bars.columns if c not in ("session", "symbol")]
    pick = F.struct((~F.col("series").isin(*prefer)).cast("int"), F.col("series"))
    return (bars.groupBy("session", "symbol")
            .agg(F.min_by(F.struct(*rest), pick).alias("r"))
            .select("session", "symbol", "r.*"))


def collapsed_rows(bars: DataFrame) -> DataFrame:
    """Rows per symbol that ``resolve_series`` leaves out."""
    return (bars.groupBy("session", "symbol").agg((F.count(F.lit(1)) - 1).alias("extra"))
            .where("extra > 0").groupBy("symbol").agg(F.sum("extra").alias("collapsed")))


def coverage(bars: DataFrame, calendar: DataFrame | None, requested: int | None = None) -> DataFrame:
    """What the history covers against what the calendar expects, as one row.

    Without a calendar the gaps are unchecked: ``sessions_expected`` is NULL and
    ``complete`` is false, since "not checked" is not "nothing missing".
    """
    have = sessions_of(bars)
    span = have.agg(F.min("session").alias("start"), F.max("session").alias("end"),
                    F.count(F.lit(1)).alias("days_loaded"))
    short = F.lit(False) if requested is None else F.col("days_loaded") < requested
    if calendar is None:
        return span.select("start", "end", "days_loaded",
                           F.lit(None).cast("long").alias("sessions_expected"),
                           F.lit(None).cast("long").alias("missing"),
                           F.lit(False).alias("calendar_checked"), short.alias("truncated"),
                           F.lit(False).alias("complete"))
    asked = calendar.where("is_session").select(F.col("day").alias("session"))
    marks = (asked.withColumn("due", F.lit(1)).join(have.withColumn("got", F.lit(1)), "session", "full")
             .select("session", "due", "got"))
    lo, hi = have.agg(F.min("session")).scalar(), have.agg(F.max("session")).scalar()
    return (marks.agg(
        F.min(F.when(F.col("got") == 1, F.col("session"))).alias("start"),
        F.max(F.when(F.col("got") == 1, F.col("session"))).alias("end"),
        F.count("got").alias("days_loaded"),
        F.count_if((F.col("due") == 1) & F.col("session").between(lo, hi)).alias("sessions_expected"),
        F.count_if((F.col("due") == 1) & F.col("got").isNull()
                   & F.col("session").between(lo, hi)).alias("missing"))
        .withColumn("calendar_checked", F.lit(True)).withColumn("truncated", short)
        .withColumn("complete", (F.col("missing") == 0) & ~F.col("truncated")))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Expected minus present."""
    due = calendar.where("is_session").select(F.col("day").alias("session"))
    return due.join(sessions_of(bars), "session", "left_anti")


def backfill_plan(bars: DataFrame, holidays: DataFrame, start, end) -> DataFrame:
    """Weekdays of the range that are neither a holiday nor already stored."""
    days = bars.sparkSession.range(1).select(F.explode(F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("session"))
    return (days.where(F.weekday("session") < 5)
            .join(holidays.select(F.col("day").alias("session")), "session", "left_anti")
            .join(sessions_of(bars), "session", "left_anti"))


def rewindow(bars: DataFrame, as_of, lookback: int | None = None, symbols=None) -> DataFrame:
    """The same cut on a panel already at hand: ranks its sessions newest first."""
    days = (sessions_of(bars).where(F.col("session") <= F.lit(as_of).cast("date"))
            .withColumn("__age", F.row_number().over(Window.orderBy(F.desc("session")))))
    if lookback is not None:
        days = days.where(F.col("__age") <= lookback)
    out = bars.join(days.select("session"), "session", "left_semi")
    return out if symbols is None else out.where(F.col("symbol").isin(list(symbols)))


def densify(bars: DataFrame, fields=("open", "high", "low", "close", "volume")) -> DataFrame:
    """Add the empty cells: every session from a symbol's first bar to the end.

    Each bar is followed by the gap up to the next one, so cells come from
    ``explode(sequence(...))`` on the bars themselves rather than from a product
    of sessions and symbols. Cells before the first bar are all-null and cannot
    change any gated window; ``lead_in`` adds them for a full matrix.
    """
    w = Window.partitionBy("symbol").orderBy("idx")
    end = bars.agg(F.max("idx")).scalar()
    spread = (bars.withColumn("__next", F.coalesce(F.lead("idx").over(w), end + 1))
              .withColumn("__at", F.explode(F.sequence(F.col("idx"), F.col("__next") - 1))))
    real = F.col("__at") == F.col("idx")
    cells = spread.select("symbol", F.col("__at").alias("idx"), real.alias("traded"),
                          *[F.when(real, F.col(f)).alias(f) for f in fields])
    cal = bars.select("idx", "session").distinct()
    return cells.join(cal, "idx")


def lead_in(bars: DataFrame, fields=("open", "high", "low", "close", "volume")) -> DataFrame:
    """The all-null cells before each symbol's first bar."""
    first = bars.groupBy("symbol").agg(F.min("idx").alias("__first")).where("__first > 0")
    cells = first.select("symbol", F.explode(F.sequence(F.lit(0), F.col("__first") - 1)).alias("idx"))
    cal = bars.select("idx", "session").distinct()
    blank = {f: F.lit(None).cast("double") for f in fields}
    return (cells.withColumns({"traded": F.lit(False), **blank}).join(cal, "idx"))


def full_matrix(bars: DataFrame, fields=("open", "high", "low", "close", "volume")) -> DataFrame:
    cols = ["symbol", "idx", "session", "traded", *fields]
    return densify(bars, fields).select(cols).unionByName(lead_in(bars, fields).select(cols))


def write_day(bars: DataFrame, path: str) -> None:
    """Replace the sessions present in ``bars``; other partitions stay.

    An empty frame is refused: writing nothing must not look like a stored day.
    """
    require_columns(bars)
    if bars.isEmpty():
        raise PanelError("refusing to write an empty day")
    (bars.repartition("session").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(path))


def read_store(spark, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return require_columns(reader.parquet(path))


def freshness(bars: DataFrame, calendar: DataFrame, today) -> DataFrame:
    """Latest stored session and how many sessions it lags ``today``."""
    today = F.lit(today).cast("date")
    latest = bars.agg(F.max("session")).scalar()
    due = calendar.where(F.col("is_session") & (F.col("day") <= today))
    return due.agg(F.max("day").alias("expected_session"),
                   F.greatest(F.count_if(F.col("day") >= latest) - 1, F.lit(0)).alias("sessions_behind")
                   ).withColumn("latest_session", latest)
