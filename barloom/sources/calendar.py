"""Session calendar: holiday files, merged years, the session dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import col

# Cash session hours (local) and clock formats seen in holiday files.
OPEN, CLOSE = "09:15", "15:30"
CLOCK = r"(\d{1,2})[:.](\d{2})\s*([ap]\.?\s*m\.?)?"


class CalendarError(ValueError):
    """A year the calendar does not hold; it is never guessed."""


def dimension(calendar: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Every day with its session flag, neighbours and running session number.

    A calendar is a few thousand rows, so one ordered window over it is bounded.
    """
    d = calendar.select("day", "is_session")
    if holidays is not None:
        off = holidays.select("day", F.lit(True).alias("off")).distinct()
        d = d.join(off, "day", "left").withColumn("is_session", F.col("is_session") & F.col("off").isNull()).drop("off")
    w = Window.orderBy("day")
    live = F.when(F.col("is_session"), F.col("day"))
    return d.withColumns({
        "next_session": F.first(live, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
        "previous_session": F.last(live, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "session_no": F.count(live).over(w.rowsBetween(Window.unboundedPreceding, 0))})


def settlement(dim: DataFrame) -> DataFrame:
    """Next-session settlement of each session."""
    return dim.where("is_session").select(F.col("day").alias("trade_day"), F.col("next_session").alias("settles_on"))


def sessions_between(dim: DataFrame, start, end) -> DataFrame:
    """Sessions of a range; a year without any calendar row is refused."""
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    years = dim.select(F.year("day").alias("y")).distinct().agg(F.collect_set("y")).scalar()
    need = F.sequence(F.year(start), F.year(end))
    guard = F.assert_true(F.size(F.array_except(need, years)) == 0, F.lit("the calendar has no data for that year"))
    return dim.where(F.col("is_session") & F.col("day").between(start, end)).where(guard.isNull())


def is_open_at(ts, in_session) -> Column:
    hhmm = F.date_format(col(ts), "HH:mm")
    return col(in_session) & (hhmm >= OPEN) & (hhmm < CLOSE)


def _clock(hour: Column, minute: Column, half: Column) -> Column:
    """HH:mm of one written time. Without am or pm an hour of 1..12 could be
    either and is refused; a twelve-hour mark needs an hour of 1..12."""
    h24 = (F.when(half == "p", F.when(hour.between(1, 12), hour % 12 + 12))
           .when(half == "a", F.when(hour.between(1, 12), hour % 12))
           .otherwise(F.when((hour == 0) | (hour >= 13), hour)))
    return F.when(minute.between(0, 59), F.format_string("%02d:%02d", h24, minute)).alias("t")


def session_window(text) -> Column:
    """Start and end clock times written in a text, sharing an am/pm mark."""
    t = F.lower(col(text))

    def part(g, i):
        return F.get(F.regexp_extract_all(t, F.lit(CLOCK), F.lit(g)), i)

    m1, m2 = (F.nullif(F.substring(part(3, i), 1, 1), F.lit("")) for i in (0, 1))
    a = _clock(part(1, 0).try_cast("int"), part(2, 0).try_cast("int"), F.coalesce(m1, m2, F.lit("-")))
    b = _clock(part(1, 1).try_cast("int"), part(2, 1).try_cast("int"), F.coalesce(m2, m1, F.lit("-")))
    ok = a.isNotNull() & b.isNotNull() & ~a.contains("null") & ~b.contains("null")
    return F.when(ok, F.struct(a.alias("opens"), b.alias("closes")))


HOLIDAY_SCHEMA = "struct<CM:array<struct<tradingDate:string,weekDay:string,description:string,morning_session:string,evening_session:string>>>"


def parse_holidays(payloads: DataFrame, body: str = "body", segment: str = "CM") -> DataFrame:
    """Holiday and special-session rows of one segment of each JSON payload."""
    rows = payloads.select(*[c for c in payloads.columns if c != body],
                           F.explode(F.from_json(body, HOLIDAY_SCHEMA)[segment]).alias("h"))
    win = F.coalesce(session_window("h.evening_session"), session_window("h.morning_session"))
    d = rows.withColumns({"day": F.to_date(F.try_to_timestamp("h.tradingDate", F.lit("dd-MMM-yyyy"))),
                          "name": F.trim("h.description"), "w": win}).where("day IS NOT NULL")
    return (d.withColumns({"opens": F.col("w.opens"), "closes": F.col("w.closes")}).drop("h", "w")
            .withColumn("kind", F.when(F.col("opens").isNotNull(), "special").otherwise("holiday")))


def merge(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fetched years replace the stored years they cover, other years stay."""
    years = fresh.select(F.year("day").alias("y")).distinct()
    kept = existing.withColumn("y", F.year("day")).join(years, "y", "left_anti").drop("y")
    newest = fresh.dropDuplicates(["day"])
    return kept.unionByName(newest, allowMissingColumns=True)
