"""Scan, window-cut, dedup and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import panel
from . import tables as t
from .oracle import BARS, CAL, DENSE, day, panel as P, r, series, sql, supp
from .registry import query

OHLCV = ("open", "high", "low", "close", "volume")
R_OHLCV = ", ".join(r(c, c) for c in OHLCV)


def dated(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in cols})


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query("2.1.1 2.10.6", sql(f"""SELECT symbol, {day('session')}, {R_OHLCV} FROM bars0
    WHERE session <= DATE '1997-06-01' AND session IN (SELECT session FROM cal
      WHERE session <= DATE '1997-06-01' ORDER BY session DESC LIMIT 24)""", supp(), CAL))
def panel_history_lookback(spark, sf):
    h = panel.history(t.bars(spark, sf, index=False), "1997-06-01", lookback=24, columns=OHLCV)
    return dated(rounded(h, *OHLCV), "session")


@query("2.1.1 2.3.6", sql(f"""SELECT symbol, {day('session')}, {r('close', 'close')} FROM bars0
    WHERE session BETWEEN DATE '1996-01-01' AND DATE '1997-06-01'
      AND symbol IN ('S1', 'S2', 'S7', 'S40')""", supp()))
def panel_history_start(spark, sf):
    h = panel.history(t.bars(spark, sf, index=False), "1997-06-01", start="1996-01-01",
                      symbols=["S1", "S2", "S7", "S40"], columns=["close"])
    return dated(rounded(h, "close"), "session")


@query("2.1.2", sql(f"""SELECT symbol, {day('session')}, {r('close', 'close')}, {r('volume', 'volume')}
    FROM bars0 WHERE session IN (SELECT session FROM cal WHERE session <= DATE '1995-03-15'
      ORDER BY session DESC LIMIT 12)""", supp(), CAL))
def panel_rewindow(spark, sf):
    h = panel.rewindow(t.bars(spark, sf, index=False), "1995-03-15", lookback=12)
    return dated(rounded(h, "close", "volume"), "session").select("symbol", "session", "close", "volume")


@query("2.1.3 2.1.7", sql(f"SELECT symbol, {day('session')}, {R_OHLCV} FROM bars0 WHERE session = DATE '1996-02-01'",
                          supp()))
def panel_load_day(spark, sf):
    b = panel.require_columns(t.bars(spark, sf, index=False))
    return dated(rounded(panel.load_day(b, "1996-02-01"), *OHLCV), "session").select(
        "symbol", "session", *OHLCV)


@query("2.1.4 2.4.26", sql(f"SELECT {day('session')}, count(DISTINCT symbol) AS symbols FROM bars0 GROUP BY session",
                    supp()))
def panel_available_days(spark, sf):
    b = t.bars(spark, sf, index=False)
    n = b.groupBy("session").agg(F.count_distinct("symbol").alias("symbols"))
    return dated(panel.available_days(b).join(n, "session"), "session")


@query("2.1.6", """SELECT strftime(CAST(date_trunc('month', l_shipdate) AS DATE), '%Y-%m-%d') AS session,
      strftime(min(l_shipdate), '%Y-%m-%d') AS first_day, strftime(max(l_shipdate), '%Y-%m-%d') AS last_day,
      count(*) AS rows, CAST(min(CAST(l_shipdate AS DATE)) = CAST(date_trunc('month', l_shipdate) AS DATE)
        AND max(CAST(l_shipdate AS DATE)) = CAST(date_trunc('month', l_shipdate) AS DATE) AS INTEGER) AS agrees
    FROM lineitem GROUP BY date_trunc('month', l_shipdate)""")
def panel_partition_guard(spark, sf):
    li = t.table(spark, sf, "lineitem").select(
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("session"),
        F.to_date("l_shipdate").alias("day"))
    g = panel.partition_guard(li, "session", "day")
    return dated(g.withColumn("agrees", F.col("agrees").cast("int")), "session", "first_day", "last_day")


@query("2.1.8 2.10.8", sql(f"""SELECT symbol, {day('session')}, series, {r('close', 'close')} FROM (
      SELECT *, row_number() OVER (PARTITION BY symbol, session
         ORDER BY CASE WHEN series = 'N' THEN 0 ELSE 1 END, series) AS rn FROM bars0) WHERE rn = 1""", series()))
def series_resolved(spark, sf):
    b = panel.resolve_series(t.series_bars(spark, sf), prefer=("N",))
    return dated(rounded(b, "close"), "session").select("symbol", "session", "series", "close")


@query("2.1.8 2.4.26", sql("""SELECT symbol, CAST(sum(n - 1) AS BIGINT) AS collapsed FROM
      (SELECT symbol, session, count(*) AS n FROM bars0 GROUP BY ALL) WHERE n > 1 GROUP BY symbol""", series()))
def series_collapsed(spark, sf):
    return panel.collapsed_rows(t.series_bars(spark, sf))


CALENDAR_SQL = """calendar AS (SELECT d AS day, dayofweek(d) NOT IN (0, 6) AS is_session FROM (
      SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM
        (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders)))"""
DAYS_SQL = """odays AS (SELECT CAST(o_orderdate AS DATE) AS session FROM orders
      WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"""


def weekday_calendar(spark, sf):
    """Weekday calendar over the span of the orders."""
    span = t.table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"),
                                            F.to_date(F.max("o_orderdate")).alias("hi"))
    return (span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
            .withColumn("is_session", F.weekday("day") < 5))


def urgent_days(spark, sf):
    return (t.table(spark, sf, "orders")
            .where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
            .select(F.to_date("o_orderdate").alias("session")))


@query("2.1.9 2.10.7", sql(f"""SELECT {day('min(h.session)', 'start')}, {day('max(h.session)', 'end')},
      count(DISTINCT h.session) AS days_loaded,
      (SELECT count(*) FROM calendar, lim WHERE is_session AND day BETWEEN lo AND hi) AS sessions_expected,
      (SELECT count(*) FROM calendar, lim WHERE is_session AND day BETWEEN lo AND hi
         AND day NOT IN (SELECT session FROM odays)) AS missing,
      1 AS calendar_checked, 0 AS truncated, 0 AS complete FROM odays h""",
    CALENDAR_SQL, DAYS_SQL, "lim AS (SELECT min(session) AS lo, max(session) AS hi FROM odays)"))
def panel_coverage(spark, sf):
    c = panel.coverage(urgent_days(spark, sf), weekday_calendar(spark, sf), requested=10)
    flags = ("calendar_checked", "truncated", "complete")
    return dated(c.withColumns({f: F.col(f).cast("int") for f in flags}), "start", "end")


@query("2.1.32 2.10.7", sql(f"""SELECT {day('day', 'session')} FROM calendar, lim WHERE is_session
      AND day BETWEEN lo AND hi AND day NOT IN (SELECT session FROM odays)""",
    CALENDAR_SQL, DAYS_SQL, "lim AS (SELECT min(session) AS lo, max(session) AS hi FROM odays)"))
def panel_missing_sessions(spark, sf):
    d = urgent_days(spark, sf)
    lo, hi = d.agg(F.min("session")).scalar(), d.agg(F.max("session")).scalar()
    m = panel.missing_sessions(d, weekday_calendar(spark, sf))
    return dated(m.where(F.col("session").between(lo, hi)), "session")


@query("2.1.32", sql(f"""SELECT {day('d', 'session')} FROM (SELECT CAST(unnest(generate_series(DATE '1994-01-01',
        DATE '1996-12-31', INTERVAL 1 DAY)) AS DATE) AS d) x
      WHERE dayofweek(d) NOT IN (0, 6) AND d NOT IN (SELECT session FROM odays)
        AND d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_totalprice > 390000)""", DAYS_SQL))
def backfill_days(spark, sf):
    hol = (t.table(spark, sf, "orders").where("o_totalprice > 390000")
           .select(F.to_date("o_orderdate").alias("day")).distinct())
    return dated(panel.backfill_plan(urgent_days(spark, sf), hol, "1994-01-01", "1996-12-31"), "session")


@query("2.1.10", sql(f"SELECT symbol, {day('session')}, {R_OHLCV} FROM bars0 WHERE symbol = 'S17'", supp()))
def panel_one_symbol(spark, sf):
    s = panel.series_of(t.bars(spark, sf, index=False), "S17")
    return dated(rounded(s, *OHLCV), "session").select("symbol", "session", *OHLCV)


@query("2.1.11 2.3.13", sql(f"""SELECT symbol, {day('session')}, CAST(close IS NOT NULL AS INTEGER) AS traded,
      {r('close', 'close')}, {r('volume', 'volume')} FROM dense""", supp("week"), CAL, DENSE))
def panel_full_matrix(spark, sf):
    m = panel.full_matrix(t.bars(spark, sf, "week"))
    m = m.withColumn("traded", F.col("traded").cast("int"))
    return dated(rounded(m, "close", "volume"), "session").select(
        "symbol", "session", "traded", "close", "volume")


@query("2.2.24", sql(f"""SELECT {day('max(o.session)', 'latest_session')},
      (SELECT {day('max(day)', 'e').replace(' AS e', '')} FROM calendar WHERE is_session AND day <= DATE '1998-07-31') AS expected_session,
      (SELECT greatest(count(*) - 1, 0) FROM calendar WHERE is_session AND day <= DATE '1998-07-31'
          AND day >= (SELECT max(session) FROM odays)) AS sessions_behind FROM odays o""", CALENDAR_SQL, DAYS_SQL))
def data_freshness(spark, sf):
    f = panel.freshness(urgent_days(spark, sf), weekday_calendar(spark, sf), "1998-07-31")
    return dated(f, "latest_session", "expected_session")


@query("2.1.5", sql(f"SELECT symbol, {day('session')}, {r('CASE WHEN session = DATE $$1997-05-01$$ THEN close * 2 ELSE close END', 'close')} FROM bars0".replace("$$", "'"), supp()))
def stored_day_replaced(spark, sf):
    """The panel goes into a session-partitioned store, one session is rewritten."""
    import uuid

    from ..session import shared_folder
    path = f"{shared_folder(spark)}/barloom-bars-{uuid.uuid4().hex}"
    panel.write_day(t.bars(spark, sf, index=False), path)
    one = t.bars(spark, sf, index=False).where("session = date'1997-05-01'").withColumn("close", F.col("close") * 2)
    panel.write_day(one, path)
    return dated(rounded(panel.read_store(spark, path).select("symbol", "session", "close"), "close"), "session")
