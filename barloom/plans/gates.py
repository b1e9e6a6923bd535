"""Universe filters, data-quality gates, adjustment, screens, text and calendar predicates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scalars import as_double, as_text, r6
from ..operators.events import MOVING_WORDS
from ..operators import features as ft, quality as ql
from ..session import cut_lineage
from ..sources import calendar as cal_src, symbols as sym
from . import tables as t
from .indicators import show
from .oracle import brand, calm, day, panel as P, r, series, sql, supp
from .registry import query
from .scans import CALENDAR_SQL, dated, rounded, weekday_calendar

DAY_SQL = """daybars AS (SELECT symbol, session, series, open, high, low, close, volume, turnover / 1000 AS turnover_lacs FROM bars0)"""
S0_SQL = """s0 AS (SELECT *, CASE WHEN series NOT IN ('N', 'R') THEN 'non-equity series' WHEN volume <= 0 THEN 'zero volume'
    WHEN close < 400 THEN 'below price floor' WHEN turnover_lacs < 60 THEN 'below liquidity floor' WHEN high = low AND volume > 0 THEN 'circuit-locked' END AS reason FROM daybars)"""


def day_frame(spark, sf):
    return t.series_bars(spark, sf).withColumn("turnover_lacs", F.col("turnover") / 1000)


@query("2.2.1 2.1.13", sql(f"""SELECT {day('session')}, coalesce(reason, 'survived') AS reason, count(*) AS rows FROM s0 GROUP BY session, reason""", series(), DAY_SQL, S0_SQL))
def stage0_exclusions(spark, sf):
    s = ql.stage0(day_frame(spark, sf), 400.0, 60.0, drop_locked=True, series=("N", "R"))
    return dated(ql.exclusion_counts(s, ["session"]), "session")


@query("2.2.1", sql(f"SELECT symbol, {day('session')}, series, {r('close', 'close')} FROM s0 WHERE reason IS NULL", series(), DAY_SQL, S0_SQL))
def stage0_survivors(spark, sf):
    s = ql.stage0(day_frame(spark, sf), 400.0, 60.0, drop_locked=True, series=("N", "R")).where("reason IS NULL")
    return show(s, "series", "close")


# a panel with planted faults: some bars lose a price, flip high and low, or drop volume
FAULT_SQL = """bad AS (SELECT symbol, session, open, CASE WHEN trades = 3 THEN low * 0.5 ELSE high END AS high, low,
    CASE WHEN trades = 2 THEN NULL WHEN trades = 4 THEN -close ELSE close END AS close,
    CASE WHEN trades = 5 THEN NULL WHEN trades = 6 THEN 0 WHEN trades = 13 THEN -volume ELSE volume END AS volume, trades FROM bars0)"""


def faulty(spark, sf):
    b, k = t.bars(spark, sf, index=False), F.col("trades")
    return b.withColumns({
        "high": F.when(k == 3, F.col("low") * 0.5).otherwise(F.col("high")),
        "close": F.when(k == 2, None).when(k == 4, -F.col("close")).otherwise(F.col("close")),
        "volume": F.when(k == 5, None).when(k == 6, 0).when(k == 13, -F.col("volume")).otherwise(F.col("volume"))})


# a panel of volume-weighted months within a band and with few faults, so that some names pass every check
MILD_SQL = """bad AS (SELECT symbol, session, px AS open, CASE WHEN sid % 5 = 1 AND trades = 3 THEN px * 0.5 ELSE px END AS high, px AS low,
    CASE WHEN sid % 5 = 2 AND trades = 2 THEN NULL ELSE px END AS close, CASE WHEN sid % 5 = 3 AND trades = 5 THEN -volume WHEN sid % 5 = 4 AND trades < 9 THEN 0 ELSE volume END AS volume, trades
    FROM (SELECT *, CAST(substr(symbol, 2) AS BIGINT) AS sid, greatest(1365, least(1635, turnover / volume)) AS px FROM bars0))"""


def mildly_faulty(spark, sf):
    b, k, s = t.bars(spark, sf, index=False), F.col("trades"), F.substring("symbol", 2, 12).cast("long")
    px = F.greatest(F.lit(1365.0), F.least(F.lit(1635.0), F.col("turnover") / F.col("volume")))
    return b.select(
        "symbol", "session", px.alias("open"), F.when((s % 5 == 1) & (k == 3), px * 0.5).otherwise(px).alias("high"), px.alias("low"),
        F.when((s % 5 == 2) & (k == 2), None).otherwise(px).alias("close"),
        F.when((s % 5 == 3) & (k == 5), -F.col("volume")).when((s % 5 == 4) & (k < 9), 0).otherwise(F.col("volume")).alias("volume"), "trades")


ACT_SQL = """acts AS (SELECT DISTINCT 'S' || l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS ex_date,
    CASE WHEN l_linenumber >= 5 THEN 'split' WHEN l_linenumber >= 3 THEN 'bonus' ELSE 'dividend' END AS type,
    CASE WHEN l_linenumber >= 5 THEN 2.0 WHEN l_linenumber >= 3 THEN 1.5 ELSE 1.0 END AS factor, l_quantity AS amount
    FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0.08 AND l_quantity >= 40)"""


def actions(spark, sf):
    li = t.table(spark, sf, "lineitem").where("l_discount = 0.1 AND l_tax = 0.08 AND l_quantity >= 40")
    n = F.col("l_linenumber")
    return li.select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("ex_date"),
                     F.when(n >= 5, "split").when(n >= 3, "bonus").otherwise("dividend").alias("type"),
                     F.when(n >= 5, 2.0).when(n >= 3, 1.5).otherwise(1.0).alias("factor"), F.col("l_quantity").alias("amount")).distinct()


LAGW = "OVER (PARTITION BY symbol ORDER BY session)"
GAP_SQL = f"""gaps AS (SELECT g.* FROM (SELECT symbol, session, open, close, lag(close) {LAGW} AS prev_close, (open / lag(close) {LAGW} - 1) * 100 AS gap_pct
    FROM SRC) g WHERE abs(gap_pct) >= LIM AND prev_close <> 0 AND NOT EXISTS (SELECT 1 FROM acts a WHERE a.symbol = g.symbol AND a.ex_date = g.session))"""
ISSUE_SQL = ["""iss AS (SELECT symbol, session, 'null_price' AS "check", 'fatal' AS severity FROM bad WHERE open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL
    UNION ALL SELECT symbol, session, 'non_positive_price', 'fatal' FROM bad WHERE least(open, high, low, close) <= 0 AND close IS NOT NULL
    UNION ALL SELECT symbol, session, 'ohlc_coherence', 'fatal' FROM bad WHERE close IS NOT NULL AND (high < low OR high < open OR high < close OR low > open OR low > close)
    UNION ALL SELECT symbol, session, 'negative_volume', 'fatal' FROM bad WHERE volume < 0
    UNION ALL SELECT symbol, session, 'null_volume', 'warn' FROM bad WHERE volume IS NULL
    UNION ALL SELECT symbol, session, 'zero_volume', 'warn' FROM bad WHERE volume = 0
    UNION ALL SELECT symbol, session, 'discontinuity', 'fatal' FROM gaps
    UNION ALL SELECT symbol, session, 'extreme_return', CASE WHEN EXISTS (SELECT 1 FROM acts a WHERE a.symbol = e.symbol AND a.ex_date = e.session) THEN 'info' ELSE 'warn' END
      FROM (SELECT symbol, session, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY session), 0) - 1 AS ret FROM bad) e WHERE abs(ret) > 0.2)"""]


@query("2.2.2 2.2.3 2.2.4 2.2.5 2.2.7 2.2.10", sql(f"""SELECT symbol, "check", CASE WHEN "check" = 'zero_volume' AND 100.0 * count(*) / n >= 20 THEN 'fatal' ELSE severity END AS severity,
      count(*) AS rows, list_transform(list(session ORDER BY session)[1:5], lambda d: strftime(d, '%Y-%m-%d')) AS sample
      FROM iss JOIN (SELECT symbol, count(*) AS n FROM bad GROUP BY symbol) USING (symbol) GROUP BY symbol, "check", severity, n""",
      supp(), FAULT_SQL, ACT_SQL, GAP_SQL.replace("SRC", "bad").replace("LIM", "20"), ISSUE_SQL))
def panel_quality(spark, sf):
    rep = ql.check_panel(faulty(spark, sf), actions(spark, sf)).where(F.col("check") != "stale_quote")
    return rep.withColumn("sample", F.transform("sample", lambda d: F.date_format(d, "yyyy-MM-dd")))


@query("2.2.6", sql(f"""SELECT symbol, n + 1 AS rows, {day('s', 'start')}, {day('e', 'end')} FROM (SELECT symbol, n, s, e, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, isle) AS k
      FROM (SELECT symbol, isle, count(*) AS n, min(prev) AS s, max(session) AS e FROM (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) {LAGW} AS isle FROM
        (SELECT symbol, session, coalesce(c = lag(c) {LAGW}, false) AS flat, lag(session) {LAGW} AS prev FROM (SELECT symbol, session, floor(close / 4000) AS c FROM bars0)))
        WHERE flat GROUP BY ALL)) WHERE k = 1 AND n >= 5""", supp()))
def stale_quotes(spark, sf):
    b = t.bars(spark, sf, index=False).withColumn("close", F.floor(F.col("close") / 4000))
    return dated(ql.stale_runs(b), "start", "end")


@query("2.2.12", sql(f"""SELECT symbol, {day('session')}, {r('prev_close', 'prev_close')}, {r('open', 'open')}, {r('gap_pct', 'gap_pct')}, {r('prev_close / open', 'implied')},
      CASE WHEN d < 0.15 THEN lb ELSE 'unexplained' END AS nearest FROM (SELECT g.*, min(abs(k - prev_close / open)) AS d, arg_min(lb, abs(k - prev_close / open)) AS lb
        FROM gaps g, (VALUES (1.5, '1:2 bonus'), (2.0, '1:1 bonus or 1-for-2 split'), (2.5, '3:2 bonus'), (3.0, '2:1 bonus or 1-for-3 split'),
          (4.0, '3:1 bonus or 1-for-4 split'), (5.0, '1-for-5 split'), (10.0, '1-for-10 split')) v(k, lb) GROUP BY ALL)""",
      supp(), ACT_SQL, GAP_SQL.replace("SRC", "bars0").replace("LIM", "20")))
def price_discontinuities(spark, sf):
    d = ql.discontinuities(t.bars(spark, sf, index=False), actions(spark, sf))
    return show(d, "prev_close", "open", "gap_pct", "implied", "nearest")


@query("2.2.13", sql("SELECT DISTINCT symbol FROM gaps", calm(), ACT_SQL, GAP_SQL.replace("SRC", "bars0").replace("LIM", "110")))
def suspect_share_counts(spark, sf):
    return ql.discontinuities(t.calm_bars(spark, sf, index=False), None, 110.0).select("symbol").distinct()


@query("2.2.7", sql(f"""SELECT severity, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM iss WHERE "check" = 'extreme_return' GROUP BY severity""",
      supp(), "bad AS (SELECT * FROM bars0)", ACT_SQL, GAP_SQL.replace("SRC", "bad").replace("LIM", "20"), ISSUE_SQL))
def extreme_returns(spark, sf):
    e = ql.extreme_returns(t.bars(spark, sf, index=False), actions(spark, sf))
    return e.groupBy("severity").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"))


@query("2.2.8", sql(f"""SELECT {day('day', 'session')}, 'warn' AS severity FROM calendar WHERE is_session AND day NOT IN (SELECT d FROM ods)
      UNION ALL SELECT {day('d', 'session')}, 'fatal' FROM ods WHERE d NOT IN (SELECT day FROM calendar WHERE is_session)""",
      CALENDAR_SQL, "ods AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT')"))
def session_gaps(spark, sf):
    o = t.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("session"))
    return dated(ql.session_issues(o, weekday_calendar(spark, sf)), "session")


@query("2.2.9", sql(f"""SELECT symbol, count(ref) AS overlap, count(*) FILTER (abs(close - ref) / ref * 100 > 25) AS off, {r('max(abs(close - ref) / ref * 100)', 'worst_pct')},
      CASE WHEN count(ref) = 0 THEN 'no overlap' WHEN count(*) FILTER (abs(close - ref) / ref * 100 > 25) > 0 THEN 'warn' ELSE 'ok' END AS status
      FROM a LEFT JOIN (SELECT symbol, session, close AS ref FROM b) USING (symbol, session) GROUP BY symbol""",
      supp("quarter", "a", "l_linestatus = 'F'"), supp("quarter", "b", "l_linestatus = 'O'")))
def reference_reconciliation(spark, sf):
    out = ql.reference_issues(t.sourced_bars(spark, sf, "F"), t.sourced_bars(spark, sf, "O"), 25.0)
    return rounded(out, "worst_pct")


@query("2.2.15", sql("""SELECT symbol, n AS rank FROM (SELECT symbol, row_number() OVER (ORDER BY tv DESC, symbol) AS n FROM (SELECT symbol, sum(turnover) AS tv FROM bars0 GROUP BY symbol))
      WHERE n <= 40 AND symbol NOT IN (SELECT symbol FROM (SELECT symbol, "check", CASE WHEN "check" = 'zero_volume' AND 100.0 * count(*) / n >= 20 THEN 'fatal' ELSE severity END AS sev
        FROM iss JOIN (SELECT symbol, count(*) AS n FROM bad GROUP BY symbol) USING (symbol) GROUP BY symbol, "check", severity, n) WHERE sev = 'fatal')""",
      supp(), MILD_SQL, ACT_SQL, GAP_SQL.replace("SRC", "bad").replace("LIM", "20"), ISSUE_SQL))
def vetted_on_every_check(spark, sf):
    """A shortlist less the names with a fatal issue of any check; the gate refuses the panel and passes what is left."""
    b, acts = t.bars(spark, sf, index=False), actions(spark, sf)
    top = b.groupBy("symbol").agg(F.sum("turnover").alias("tv")).orderBy(F.desc("tv"), "symbol").limit(40)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tv"), "symbol")))  # forty rows
    panel = cut_lineage(mildly_faulty(spark, sf))
    left = cut_lineage(ql.vet(top, ql.check_panel(panel, acts)).select("symbol", F.col("rank").cast("long").alias("rank")))
    ql.assert_clean(panel.join(left, "symbol", "left_semi"), acts)
    return left


@query("2.2.11", sql("""SELECT count(*) > 0 AS refused FROM iss WHERE severity = 'fatal'""", supp(), MILD_SQL, ACT_SQL, GAP_SQL.replace("SRC", "bad").replace("LIM", "20"), ISSUE_SQL))
def panel_refused(spark, sf):
    """Whether the hard gate refuses the panel as it is."""
    try:
        ql.assert_clean(mildly_faulty(spark, sf), actions(spark, sf))
        refused = False
    except ql.QualityError:
        refused = True
    return spark.range(1).select(F.lit(refused).alias("refused"))


@query("2.2.11 2.2.15", sql("""SELECT symbol, n AS rank FROM (SELECT symbol, row_number() OVER (ORDER BY tv DESC, symbol) AS n FROM (SELECT symbol, sum(turnover) AS tv FROM bars0 GROUP BY symbol))
      WHERE n <= 40 AND symbol NOT IN (SELECT symbol FROM bad WHERE trades = 13 AND volume < 0)""", supp(), FAULT_SQL))
def vetted_shortlist(spark, sf):
    b = t.bars(spark, sf, index=False)
    top = b.groupBy("symbol").agg(F.sum("turnover").alias("tv")).orderBy(F.desc("tv"), "symbol").limit(40)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tv"), "symbol")))  # forty rows
    bad = ql.row_issues(faulty(spark, sf)).where(F.col("check") == "negative_volume")
    return ql.vet(top, bad).select("symbol", F.col("rank").cast("long").alias("rank"))


ADJ = "(SELECT coalesce(exp(sum(ln(m))), 1.0) FROM steps s WHERE s.symbol = b.symbol AND s.ex_date > b.session)"


@query("2.5.62 2.5.63", sql(f"""SELECT symbol, {day('session')}, {r('f', 'adj_factor')}, {r('close * f', 'adj_close')}, {r('volume / f', 'adj_volume')} FROM (SELECT b.*, {ADJ} AS f FROM bars0 b)""",
      supp(), ACT_SQL, """steps AS (SELECT symbol, ex_date, 1.0 / factor AS m FROM acts WHERE type IN ('split', 'bonus') AND ex_date <= DATE '2000-06-01' UNION ALL
        SELECT a.symbol, a.ex_date, (ref - amount) / ref FROM (SELECT a.*, (SELECT arg_max(close, session) FROM bars0 b WHERE b.symbol = a.symbol AND b.session < a.ex_date) AS ref
          FROM acts a WHERE type = 'dividend' AND ex_date <= DATE '2000-06-01') a WHERE ref > 0 AND amount < ref)"""))
def adjusted_bars(spark, sf):
    a = ql.adjust(t.bars(spark, sf, index=False), actions(spark, sf), "2000-06-01", dividends=True)
    return show(a, "adj_factor", "adj_close", "adj_volume")


SCREENS = {"cheap": (("o_totalprice", "lt", 60000.0), ("c_acctbal", "gt", 0.0)), "rich": (("c_acctbal", "gte", 7000.0),),
           "exact": (("o_orderstatus", "eq", "F"), ("o_totalprice", "lte", 200000.0)), "unmapped": (("pe_ttm", "lt", 15.0),)}


@query("2.2.16 2.2.17", """SELECT 'cheap' AS screen, count(*) FILTER (o_totalprice < 60000 AND bal > 0) AS passed, CAST(NULL AS VARCHAR) AS missing FROM j
      UNION ALL SELECT 'rich', count(*) FILTER (bal >= 7000), NULL FROM j UNION ALL SELECT 'exact', count(*) FILTER (o_orderstatus = 'F' AND o_totalprice <= 200000), NULL FROM j
      UNION ALL SELECT 'unmapped', NULL, 'pe_ttm'""".join(["WITH j AS (SELECT *, nullif(greatest(c_acctbal, 0), 0) AS bal FROM orders JOIN customer ON o_custkey = c_custkey) ", ""]))
def screens(spark, sf):
    o, c = t.table(spark, sf, "orders"), t.table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return ql.screen_report(j, SCREENS)


# ---- text and calendar predicates ---------------------------------------

SYM_IN = """raw AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NSE:' || upper(replace(p_brand, '#', '')) WHEN 1 THEN replace(p_brand, '#', '-') || '.NS'
    WHEN 2 THEN replace(p_brand, '#', '&') || '.bse' WHEN 3 THEN p_brand || '.XX' ELSE ' ' || replace(p_brand, '#', '') || ' ' END AS s FROM part)"""


@query("2.2.21 2.11.1", sql("""SELECT p_partkey, base, CASE WHEN base IS NULL THEN NULL ELSE ex END AS exchange, CASE WHEN base IS NULL THEN NULL ELSE base || CASE ex WHEN 'NSE' THEN '.NS' ELSE '.BO' END END AS dialect
    FROM (SELECT p_partkey, CASE WHEN ex IS NOT NULL AND regexp_full_match(b, '[A-Z0-9][A-Z0-9&-]{0,29}') THEN b END AS base, ex FROM (
      SELECT p_partkey, CASE WHEN u LIKE '%:%' THEN split_part(u, ':', 2) WHEN u LIKE '%.%' THEN split_part(u, '.', 1) ELSE u END AS b,
        CASE WHEN u LIKE '%:%' THEN CASE split_part(u, ':', 1) WHEN 'NSE' THEN 'NSE' WHEN 'BSE' THEN 'BSE' END
             WHEN u LIKE '%.%' THEN CASE split_part(u, '.', 2) WHEN 'NS' THEN 'NSE' WHEN 'NSE' THEN 'NSE' WHEN 'BO' THEN 'BSE' WHEN 'BSE' THEN 'BSE' END ELSE 'NSE' END AS ex
      FROM (SELECT p_partkey, upper(trim(s)) AS u FROM raw)))""", SYM_IN))
def symbol_dialects(spark, sf):
    p, k, b = t.table(spark, sf, "part"), F.col("p_partkey") % 5, F.col("p_brand")
    s = (F.when(k == 0, F.concat(F.lit("NSE:"), F.upper(F.replace(b, F.lit("#"), F.lit("")))))
         .when(k == 1, F.concat(F.replace(b, F.lit("#"), F.lit("-")), F.lit(".NS")))
         .when(k == 2, F.concat(F.replace(b, F.lit("#"), F.lit("&")), F.lit(".bse")))
         .when(k == 3, F.concat(b, F.lit(".XX"))).otherwise(F.concat(F.lit(" "), F.replace(b, F.lit("#"), F.lit("")), F.lit(" "))))
    out = sym.parse(p.select("p_partkey", s.alias("raw")), "raw")
    return out.select("p_partkey", "base", "exchange", sym.translate("yahoo").alias("dialect"))


@query("2.2.22", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS txt,
    CASE WHEN o_orderkey % 6 IN (0, 1, 2, 3) THEN NULL ELSE floor(o_totalprice * 1e6 + 0.5) / 1e6 END AS num FROM orders""")
def absent_values(spark, sf):
    o, k = t.table(spark, sf, "orders"), F.col("o_orderkey")
    words = F.when(k % 8 == 0, " NA ").when(k % 4 == 0, "-").otherwise(F.concat(F.lit("  "), "o_orderpriority"))
    nums = (F.when(k % 6 == 0, "null").when(k % 6 == 1, "NaN").when(k % 6 == 2, "Infinity").when(k % 6 == 3, "12abc")
            .otherwise(F.col("o_totalprice").cast("string")))
    return o.select("o_orderkey", as_text(words).alias("txt"), r6(as_double(nums), "num"))


PRICE_WORDS = "|".join(MOVING_WORDS)


@query("2.2.18", f"""SELECT doc_id, CAST(regexp_matches(lower(source || ' ' || text), '{PRICE_WORDS}') AS INTEGER) AS moving FROM documents""")
def price_moving_events(spark, sf):
    from ..operators.events import is_price_moving
    return t.table(spark, sf, "documents").select("doc_id", is_price_moving("source", "text").cast("int").alias("moving"))


HOL = "hol AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 350000)"
DIM = """dim AS (SELECT day, is_session, first_value(day) OVER nxt AS next_session FROM (SELECT day, is_session AND day NOT IN (SELECT day FROM hol) AS is_session FROM calendar) WINDOW nxt AS (ORDER BY day))"""


@query("2.2.23", sql(f"""SELECT {day('c.day', 'day')}, CAST(c.ok AS INTEGER) AS is_session, strftime((SELECT min(day) FROM ok o WHERE o.day > c.day), '%Y-%m-%d') AS next_session,
      strftime((SELECT max(day) FROM ok o WHERE o.day < c.day), '%Y-%m-%d') AS previous_session, (SELECT count(*) FROM ok o WHERE o.day <= c.day) AS session_no
      FROM (SELECT day, is_session AND day NOT IN (SELECT day FROM hol) AS ok FROM calendar) c""", CALENDAR_SQL, HOL,
      "ok AS (SELECT day FROM calendar WHERE is_session AND day NOT IN (SELECT day FROM hol))"))
def calendar_dimension(spark, sf):
    hol = t.table(spark, sf, "orders").where("o_totalprice > 350000").select(F.to_date("o_orderdate").alias("day")).distinct()
    d = cal_src.dimension(weekday_calendar(spark, sf), hol)
    return dated(d.withColumn("is_session", F.col("is_session").cast("int")), "day", "next_session", "previous_session")


@query("2.2.23", sql("""SELECT event_id, CAST(is_session AND hhmm >= '09:15' AND hhmm < '15:30' AS INTEGER) AS open FROM (SELECT event_id, dayofweek(ts) NOT IN (0, 6) AS is_session,
      strftime(ts, '%H:%M') AS hhmm FROM events)"""))
def open_at_time(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", "ts")
    return e.select("event_id", cal_src.is_open_at("ts", F.weekday("ts") < 5).cast("int").alias("open"))
