"""Ingest queries: text derived from the tables goes through the parsers and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import events as ev, panel
from ..sources import actions as ca, calendar as cal, files as fl, news, research as rs_
from . import tables as t
from .indicators import show
from .oracle import HOURS, IND, day, r, series, sql, supp
from .registry import query
from .scans import dated, rounded

fmt = F.format_string


def equity_lines(spark, sf):
    """Exchange-style CSV text of every bar of every series."""
    b = t.series_bars(spark, sf)
    num = lambda c: F.col(c).cast("string")
    line = F.concat_ws(",", F.concat(F.lit(" "), F.lower("symbol")), F.concat(F.lit(" "), "series"), F.concat(F.lit(" "), F.date_format("session", "dd-MMM-yyyy")), num("open"),
                       num("open"), num("high"), num("low"), num("close"), num("close"), num("open"), num("volume"), num("turnover"), num("trades"),
                       F.when(F.col("trades") % 3 == 0, " -").otherwise(num("volume")), F.when(F.col("trades") % 3 == 0, "").otherwise(F.lit("55.5")))
    return b.select(line.alias("line"))


@query("2.1.12 2.1.13 2.11.1", sql(f"""SELECT symbol || '.NS' AS symbol, series, {day('session')}, {r('close', 'close')}, {r('volume', 'volume')},
      {r('CASE WHEN trades % 3 <> 0 THEN volume END', 'delivery_qty')}, {r('CASE WHEN trades % 3 <> 0 THEN 55.5 END', 'delivery_pct')} FROM bars0 WHERE series = 'N'""", series()))
def equity_file_ingest(spark, sf):
    raw = fl.split_lines(equity_lines(spark, sf), "line", fl.EQUITY_COLS)
    b = fl.equity_bars(raw).where(F.col("series").isin("N"))
    return show(b, "series", "close", "volume", "delivery_qty", "delivery_pct")


def isin_of(c):
    return F.concat(F.lit("IN"), F.lpad(F.col(c).cast("string"), 10, "0"))


@query("2.1.14", sql(f"""SELECT symbol, 'IN' || lpad(substr(symbol, 2), 10, '0') AS isin, {day('session')}, {r('close', 'close')}, {r('turnover', 'turnover')} FROM bars0 WHERE series <> 'R'""", series()))
def second_exchange_ingest(spark, sf):
    b = t.series_bars(spark, sf)
    vals = [F.date_format("session", "yyyy-MM-dd"), F.when(F.col("series") == "R", "IDX").otherwise("STK"), F.concat(F.lit("IN"), F.lpad(F.substring("symbol", 2, 9), 10, "0")),
            F.lower("symbol"), "series", "open", "high", "low", "close", F.lit(""), "volume", "turnover", F.lit("-")]
    line = F.concat_ws(",", *[v.cast("string") if not isinstance(v, str) else F.col(v).cast("string") for v in vals])
    return show(fl.second_bars(fl.split_lines(b.select(line.alias("line")), "line", fl.SECOND_COLS)), "isin", "close", "turnover")


FO_SQL = """fo AS (SELECT p_brand AS symbol, l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber % 2 = 0 THEN 'CE' ELSE 'PE' END AS ot,
     CASE WHEN l_discount = 0 THEN 0.0 ELSE l_quantity END AS vol, l_discount * 9000 AS oi FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("2.1.15 2.1.16", sql(f"""SELECT coalesce(why, 'kept') AS reason, coalesce(ot, 'future') AS kind, count(*) AS rows, {r('sum(l_quantity)', 'lots')} FROM (SELECT *, CASE WHEN l_linenumber = 6 THEN 'malformed' WHEN vol <= 0 THEN 'untraded'
      WHEN oi < 200 THEN 'open interest' WHEN ot = 'CE' AND l_quantity * 10 < greatest(260 - 100, 0) - 0.05 THEN 'below intrinsic' END AS why FROM fo) GROUP BY ALL""", FO_SQL))
def derivatives_ingest(spark, sf):
    part = t.table(spark, sf, "part").select("p_partkey", "p_brand")
    li = t.table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    v = {"TradDt": F.when(n == 6, "bad").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")), "TckrSymb": F.concat(F.lit(" "), F.lower("p_brand")), "FinInstrmTp": F.lit("STO"),
         "XpryDt": F.date_format(F.date_add("l_shipdate", 28), "yyyy-MM-dd"), "StrkPric": F.when(n == 7, "").otherwise("100"),
         "OptnTp": F.when(n == 7, "").when(n % 2 == 0, "ce").otherwise("pe"), "ClsPric": (F.col("l_quantity") * 10).cast("string"), "UndrlygPric": F.lit("260"),
         "OpnIntrst": (F.col("l_discount") * 9000).cast("string"), "TtlTradgVol": F.when(F.col("l_discount") == 0, "0").otherwise(F.col("l_quantity").cast("string")),
         "NewBrdLotQty": F.col("l_quantity").cast("string")}
    line = F.concat_ws(",", *[v.get(c, F.lit("")) for c in fl.FO_COLS])
    c = fl.contracts(fl.split_lines(li.select(line.alias("line")), "line", fl.FO_COLS)).withColumn("reason", fl.contract_reason(True, 200.0, True))
    return c.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), F.coalesce("option_type", F.lit("future")).alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"), r6(F.sum("lot_size"), "lots"))


ISIN_SQL = """im AS (SELECT 'C' || c_custkey AS base, CASE WHEN c_custkey % 13 = 0 THEN 'XX123' WHEN c_custkey % 10 = 0 THEN 'IN' || lpad(CAST(c_nationkey AS VARCHAR), 10, '0') ELSE 'IN' || lpad(CAST(c_custkey + 100000 AS VARCHAR), 10, '0') END AS isin FROM customer),
    cl AS (SELECT isin, count(*) AS n FROM im WHERE regexp_full_match(isin, 'IN[A-Z0-9]{10}') GROUP BY isin)"""


@query("2.1.17", sql("SELECT base, isin, CAST(regexp_full_match(isin, 'IN[A-Z0-9]{10}') AS INTEGER) AS valid, CAST(coalesce(n, 0) > 1 AS INTEGER) AS ambiguous FROM im LEFT JOIN cl USING (isin)", ISIN_SQL))
def isin_master(spark, sf):
    m = fl.isin_master(isin_lines(spark, sf))
    return m.withColumns({c: F.col(c).cast("int") for c in ("valid", "ambiguous")})


def isin_lines(spark, sf):
    """Two lines per customer; the second is the one that counts."""
    c, k = t.table(spark, sf, "customer"), F.col("c_custkey")
    isin = F.when(k % 13 == 0, "XX123").when(k % 10 == 0, F.concat(F.lit("IN"), F.lpad(F.col("c_nationkey").cast("string"), 10, "0"))).otherwise(
        F.concat(F.lit("IN"), F.lpad((k + 100000).cast("string"), 10, "0")))
    d = c.select(F.concat(F.lit("c"), k, F.lit(".NS")).alias("SYMBOL"), isin.alias("good"), F.explode(F.array(F.lit(1), F.lit(2))).alias("line"))
    return d.select("SYMBOL", F.when(F.col("line") == 1, "IN0000000000").otherwise(F.col("good")).alias("ISIN"), "line")


CROSS_SQL = ["nse AS (SELECT 'C' || o_custkey AS base, CAST(date_trunc('month', o_orderdate) AS DATE) AS session, avg(o_totalprice) AS close FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL)",
             "bse AS (SELECT isin, session, avg(p) AS close, sum(p) AS turnover FROM (SELECT isin, CAST(date_trunc('month', o_orderdate) AS DATE) AS session, o_totalprice AS p FROM orders JOIN im ON base = 'C' || o_custkey WHERE o_orderstatus <> 'F') GROUP BY ALL)",
             """bk AS (SELECT n.base, n.session, n.close, b.close AS ref, b.turnover, CASE WHEN cl.n > 1 THEN 'ambiguous_isin' WHEN im.isin IS NULL THEN 'no_isin' WHEN b.close IS NULL THEN 'not_on_other' WHEN b.turnover < 150000 THEN 'thin' WHEN b.close <= 0 THEN 'no_usable_close' ELSE 'checkable' END AS bucket
                  FROM nse n LEFT JOIN (SELECT * FROM im WHERE base NOT LIKE '%7') im USING (base) LEFT JOIN cl ON cl.isin = im.isin LEFT JOIN bse b ON b.isin = im.isin AND b.session = n.session AND NOT coalesce(cl.n > 1, false))"""]


def crossed(spark, sf):
    from ..operators import crosscheck as cx
    o = t.table(spark, sf, "orders").withColumn("session", F.to_date(F.date_trunc("month", "o_orderdate")))
    nse = o.where("o_orderstatus <> 'O'").groupBy(F.concat(F.lit("C"), "o_custkey", F.lit(".NS")).alias("symbol"), "session").agg(F.avg("o_totalprice").alias("close"))
    ids = fl.isin_master(isin_lines(spark, sf))
    right = (o.where("o_orderstatus <> 'F'").join(ids, F.col("base") == F.concat(F.lit("C"), "o_custkey"))
             .groupBy("isin", "session").agg(F.avg("o_totalprice").alias("close"), F.sum("o_totalprice").alias("turnover")))
    return cx.bucketed(nse, right, ids.where("base NOT LIKE '%7'").select("base", "isin", "ambiguous"), 150000.0)


@query("2.3.4", sql("SELECT bucket, count(*) AS rows FROM bk GROUP BY bucket", ISIN_SQL, CROSS_SQL))
def cross_source_buckets(spark, sf):
    from ..operators import crosscheck as cx
    return cx.bucket_counts(crossed(spark, sf))


@query("2.3.5", sql(f"SELECT base || '.NS' AS symbol, {day('session')}, {r('close', 'close')}, {r('ref', 'ref_close')}, {r('abs(close - ref) / ref * 100', 'diff_pct')} FROM bk WHERE bucket = 'checkable' AND abs(close - ref) / ref * 100 > 2", ISIN_SQL, CROSS_SQL))
def cross_source_differences(spark, sf):
    from ..operators import crosscheck as cx
    d = cx.reconcile(crossed(spark, sf), 2.0)
    return dated(rounded(d.select("symbol", "session", "close", "ref_close", "diff_pct"), "close", "ref_close", "diff_pct"), "session")


@query("2.1.18 2.1.19 2.1.20", """WITH raw AS (SELECT 'S' || s_suppkey AS base, n_name AS industry, 'NIFTY_' || r_name AS idx, 1 AS pr FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 4 <> 0
      UNION ALL SELECT 'S' || s_suppkey, r_name, 'BROAD', 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 <> 0)
      SELECT base, arg_min(industry, pr) AS industry, string_agg(idx, '|' ORDER BY pr) AS indices FROM raw GROUP BY base""")
def sector_map(spark, sf):
    m = fl.sector_map(constituent_rows(spark, sf))
    return m.withColumn("indices", F.array_join("indices", "|"))


def constituent_rows(spark, sf):
    i = (t.table(spark, sf, "supplier").join(F.broadcast(t.table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
         .join(F.broadcast(t.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")))
    k = F.col("s_suppkey")
    line = lambda ind: F.concat_ws(",", F.concat(F.lit("s"), k, F.lit(".NS ")), ind)
    a = i.where(k % 4 != 0).select(line(F.col("n_name")).alias("line"), F.concat(F.lit("NIFTY_"), "r_name").alias("index"), F.lit(1).alias("priority"))
    b = i.where(k % 3 != 0).select(line(F.col("r_name")).alias("line"), F.lit("BROAD").alias("index"), F.lit(2).alias("priority"))
    return fl.constituents(fl.split_lines(a.unionByName(b), "line", ("Symbol", "Industry")))


@query("2.1.20", "SELECT count(*) FILTER (s_suppkey % 4 <> 0 OR s_suppkey % 3 <> 0) AS classified, count(*) AS asked FROM supplier")
def sector_coverage(spark, sf):
    asked = t.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".BO")).alias("symbol"))
    return fl.sector_coverage(asked, fl.sector_map(constituent_rows(spark, sf)))


# ---- corporate actions ---------------------------------------------------

def subjects(spark, sf):
    """A subject line written from each order, in the exchange's wording."""
    o, k = t.table(spark, sf, "orders"), F.col("o_orderkey") % 13
    a, b = F.col("o_custkey") % 8 + 2, F.col("o_custkey") % 3 + 1
    older = F.floor(F.col("o_orderkey") / 13) % 2 == 1  # the spelling without blanks
    text = (F.when((k == 0) & older, F.concat(F.lit("Face Value Split From Rs."), a * 5, F.lit("/- To Rs."), b, F.lit("/-")))
            .when((k == 2) & older, F.concat(F.lit("Annual General Meeting/Dividend-Rs."), a, F.lit(".50 Per Share (Including Special Dividend Of Rs."), b, F.lit("/- Per Share).")))
            .when(k == 0, F.concat(F.lit("Face Value Split (Sub-Division) - From Rs "), a * 5, F.lit("/- Per Share To Rs "), b, F.lit("/- Per Share")))
            .when(k == 1, F.concat(F.lit("Bonus "), b, F.lit(":"), a)).when(k == 2, F.concat(F.lit("Interim Dividend - Rs "), a, F.lit(".50 Per Share")))
            .when(k == 3, F.concat(F.lit("Final Dividend - Rs 1,"), a, F.lit("00 Per Share And Special Dividend - Re "), b, F.lit(" Including Dividend Rs 3")))
            .when(k == 4, "Rights 1:4 @ Premium Rs 20/-").when(k == 5, F.lit("Annual General Meeting")).when(k == 6, F.concat(F.lit("Bonus "), b, F.lit(":"), a, F.lit(" / Stock Split From Rs "), a * 5, F.lit(" To Rs "), b))
            .when(k == 7, F.lit("   ")).when(k == 9, F.concat(F.lit("Bonus "), b, F.lit(":"), a, F.lit(" / Stock Split")))
            .when(k == 10, F.concat(F.lit("Interim Dividend - Rs "), a, F.lit(" Per Share / Stock Split"))).when(k == 11, F.concat(F.lit("Face Value Split From Rs "), a * 5, F.lit(" To Rs "), b, F.lit(" And Bonus Debentures")))
            .when(k == 12, F.concat(F.lit("Bonus Debentures / Rights "), b, F.lit(":"), a)).otherwise("Change Of Name"))
    return o.select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.when(F.col("o_orderkey") % 50 != 0, F.to_date("o_orderdate")).alias("ex_date"), text.alias("subject"))


SUBJ = """SELECT o_orderkey, CASE WHEN k IN (0, 6, 11) THEN 'split' WHEN k IN (1, 9) THEN 'bonus' WHEN k IN (2, 3, 10) THEN 'dividend' END AS type, CASE k WHEN 0 THEN a * 5 / b WHEN 11 THEN a * 5 / b WHEN 10 THEN 1.0 WHEN 9 THEN (b + a) / a WHEN 1 THEN (b + a) / a WHEN 6 THEN a * 5 / b * (b + a) / a WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 END AS factor,
      CASE WHEN k IN (0, 1, 6, 9, 11) THEN 0.0 WHEN k = 10 THEN a WHEN k = 2 THEN a + 0.5 WHEN k = 3 THEN 1000 + a * 100 + b END AS amount,
      CASE k WHEN 4 THEN 'moves the price but is no single factor' WHEN 12 THEN 'moves the price but is no single factor' WHEN 5 THEN 'leaves the price alone' WHEN 7 THEN 'blank subject' WHEN 8 THEN 'unrecognised subject' END AS reason
      FROM (SELECT o_orderkey, o_orderkey % 13 AS k, CAST(o_custkey % 8 + 2 AS DOUBLE) AS a, CAST(o_custkey % 3 + 1 AS DOUBLE) AS b FROM orders)"""


@query("2.1.21 2.1.23 2.11.2", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 AND coalesce(reason, '') <> 'blank subject' THEN NULL ELSE type END AS type, {r('factor', 'factor')}, {r('amount', 'amount')},
      CASE WHEN o_orderkey % 50 = 0 AND coalesce(reason, '') <> 'blank subject' THEN 'ex-date missing' ELSE reason END AS reason FROM ({SUBJ})""")
def action_subjects(spark, sf):
    p = ca.parse_rows(subjects(spark, sf))
    return rounded(p.select("o_orderkey", "type", "factor", "amount", "reason"), "factor", "amount")


@query("2.1.22 2.11.14", sql(f"""SELECT symbol, {day('ex', 'ex_date')}, type, {r('factor', 'factor')} FROM (SELECT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS ex, s.type, s.factor FROM orders o JOIN ({SUBJ}) s USING (o_orderkey)
      WHERE s.reason IS NULL AND o_orderkey % 50 <> 0)"""))
def action_files(spark, sf):
    a = ca.actions(ca.parse_rows(subjects(spark, sf))).withColumn("note", F.col("subject"))
    body = a.groupBy("symbol", F.floor(F.col("o_orderkey") / 1000).alias("b")).agg(F.to_json(F.struct("symbol", F.collect_list(F.struct(F.col("ex_date").cast("string").alias("ex_date"), "type", "factor", "amount", "note")).alias("actions"))).alias("body"))
    out = ca.load_files(body.select("body"))
    return dated(rounded(out.select("symbol", "ex_date", "type", "factor"), "factor"), "ex_date")


@query("2.1.22", "SELECT 'C' || c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 13 IN (0, 1, 2, 3, 6, 9, 10, 11) AND o_orderkey % 50 <> 0)")
def symbols_without_actions(spark, sf):
    asked = t.table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"))
    return ca.without_file(asked, ca.actions(ca.parse_rows(subjects(spark, sf))))


# ---- calendar ------------------------------------------------------------

def holiday_payload(spark, sf, where="true"):
    o = t.table(spark, sf, "orders").where(f"o_totalprice > 380000 AND {where}")
    k = F.col("o_orderkey") % 4
    h = F.struct(F.date_format("o_orderdate", "dd-MMM-yyyy").alias("tradingDate"), F.lit("").alias("weekDay"), F.concat(F.lit(" H"), "o_orderkey", F.lit(" ")).alias("description"),
                 F.when(k == 1, "10:00 to 13:30").when(k == 2, "Closed").otherwise("").alias("morning_session"),
                 F.when(k == 3, "6:15 to 7.30 p.m.").when(k == 1, "5:00 - 6:00").otherwise("").alias("evening_session"))
    return o.groupBy(F.floor(F.col("o_orderkey") / 16).alias("b")).agg(F.to_json(F.struct(F.collect_list(h).alias("CM"))).alias("body"))


@query("2.1.24", f"""SELECT {day('CAST(o_orderdate AS DATE)', 'day')}, 'H' || o_orderkey AS name, CASE WHEN o_orderkey % 4 = 3 THEN 'special' ELSE 'holiday' END AS kind,
      CASE WHEN o_orderkey % 4 = 3 THEN '18:15' END AS opens, CASE WHEN o_orderkey % 4 = 3 THEN '19:30' END AS closes FROM orders WHERE o_totalprice > 380000""")
def holiday_master(spark, sf):
    h = cal.parse_holidays(holiday_payload(spark, sf).select("body"))
    return dated(h.select("day", "name", "kind", "opens", "closes"), "day")


@query("2.1.25", f"""WITH fresh AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 380000 AND year(o_orderdate) >= 1997),
      old AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 360000)
      SELECT {day('day', 'day')} FROM old WHERE year(day) NOT IN (SELECT year(day) FROM fresh) UNION ALL SELECT {day('day', 'day')} FROM fresh""")
def merged_calendar(spark, sf):
    fresh = cal.parse_holidays(holiday_payload(spark, sf, "year(o_orderdate) >= 1997").select("body")).select("day")
    old = t.table(spark, sf, "orders").where("o_totalprice > 360000").select(F.to_date("o_orderdate").alias("day")).distinct()
    return dated(cal.merge(old, fresh), "day")


# ---- disclosures ---------------------------------------------------------

def result_payload(spark, sf):
    o, k = t.table(spark, sf, "orders"), F.col("o_orderkey")
    ts = F.col("o_orderdate")
    row = F.struct(F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.when(k % 3 == 0, "Audited").when(k % 3 == 1, "Un-Audited").otherwise("-").alias("audited"),
                   F.when(k % 5 == 0, "Consolidated").when(k % 5 == 1, "Non-Consolidated").alias("consolidated"),
                   F.when(k % 4 == 0, F.date_format(ts, "dd-MMM-yyyy HH:mm:ss")).when(k % 4 == 1, "-").otherwise("").alias("broadCastDate"),
                   F.when(k % 4 == 1, F.date_format(F.date_add(ts, 1), "yyyy-MM-dd")).otherwise("NA").alias("exchdisstime"),
                   F.when(k % 4 == 2, F.date_format(F.date_add(ts, 2), "dd-MMM-yyyy HH:mm")).alias("filingDate"), F.date_format(F.date_trunc("quarter", ts), "dd-MMM-yyyy").alias("fromDate"),
                   F.date_format(ts, "dd-MMM-yyyy").alias("toDate"), F.lit("Quarterly").alias("period"), F.when(k % 2 == 0, "http://x/-").otherwise(F.concat(F.lit("http://x/"), k)).alias("xbrl"), F.lit("null").alias("isin"))
    return o.groupBy(F.floor(k / 16).alias("b")).agg(F.to_json(F.collect_list(row)).alias("body")).select("body")


@query("2.1.26 2.11.10 2.11.14", f"""SELECT 'C' || o_custkey AS symbol, {day("CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 2 DAY END", 'disclosed')}, {day("date_trunc('quarter', o_orderdate)", 'period_start')},
      CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS DOUBLE) AS audited, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS DOUBLE) AS consolidated, CASE WHEN o_orderkey % 2 = 1 THEN 'http://x/' || o_orderkey END AS xbrl_url
      FROM orders WHERE o_orderkey % 4 <> 3""")
def results_ingest(spark, sf):
    out = rs_.results(rs_.parse(result_payload(spark, sf), "result"))
    out = out.select("symbol", F.col("disclosed_at").alias("disclosed"), "period_start", F.col("audited").cast("double"), F.col("consolidated").cast("double"), "xbrl_url")
    return dated(out, "disclosed", "period_start")


@query("2.1.26", "SELECT 'C' || o_custkey AS symbol, 'result' AS kind, 'no disclosure time' AS reason, count(*) AS rows FROM orders WHERE o_orderkey % 4 = 3 GROUP BY o_custkey")
def undated_quarantine(spark, sf):
    u = rs_.undated(rs_.parse(result_payload(spark, sf), "result"), "result")
    return u.groupBy("symbol", "kind", "reason").agg(F.count("raw").alias("rows"))


@query("2.1.26", f"""SELECT 'S' || s_suppkey AS symbol, {r('s_acctbal', 'promoter_pct')}, {r('CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END', 'public_pct')} FROM supplier""")
def shareholding_ingest(spark, sf):
    s = t.table(spark, sf, "supplier")
    row = F.struct(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), F.lit("31-Mar-1997").alias("date"), F.lit("-").alias("broadcastDate"), F.lit("1997-04-20 10:11:12").alias("systemDate"),
                   F.col("s_acctbal").cast("string").alias("pr_and_prgrp"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey").cast("string")).otherwise("-").alias("public_val"), F.lit(None).cast("string").alias("employeeTrusts"))
    p = s.groupBy(F.floor(F.col("s_suppkey") / 16).alias("b")).agg(F.to_json(F.collect_list(row)).alias("body")).select("body")
    return rounded(rs_.shareholding(rs_.parse(p, "shareholding")).select("symbol", "promoter_pct", "public_pct"), "promoter_pct", "public_pct")


def order_payload(spark, sf, *fields):
    """A JSON array of rows made from each order, sixteen order keys a body."""
    o = t.table(spark, sf, "orders")
    return o.groupBy(F.floor(F.col("o_orderkey") / 16).alias("b")).agg(F.to_json(F.collect_list(F.struct(*fields))).alias("body")).select("body")


@query("2.1.26", f"""SELECT symbol, {day("CASE k WHEN 0 THEN d ELSE d + INTERVAL 1 DAY END", 'disclosed')}, CASE WHEN o_orderkey % 7 <> 0 THEN 'Outcome of Board Meeting' END AS category, 'order ' || o_orderkey AS text,
      CASE WHEN o_orderkey % 3 = 1 THEN 'http://x/' || o_orderkey || '.pdf' END AS attachment_url FROM (SELECT 'C' || o_custkey AS symbol, o_orderkey, o_orderkey % 4 AS k, o_orderdate AS d FROM orders) WHERE k < 3""")
def announcements_ingest(spark, sf):
    k, ts = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    p = order_payload(spark, sf, F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.when(k % 7 != 0, " Outcome of Board Meeting ").otherwise("-").alias("desc"),
                      F.when(k % 4 == 0, F.date_format(ts, "dd-MMM-yyyy HH:mm:ss")).otherwise("-").alias("an_dt"), F.when(k % 4 == 1, F.date_format(F.date_add(ts, 1), "yyyy-MM-dd HH:mm:ss")).alias("sort_date"),
                      F.when(k % 4 == 2, F.date_format(F.date_add(ts, 1), "dd-MMM-yyyy")).otherwise("NA").alias("exchdisstime"), F.concat(F.lit("order "), k).alias("attchmntText"),
                      F.when(k % 3 == 1, F.concat(F.lit("http://x/"), k, F.lit(".pdf"))).otherwise("null").alias("attchmntFile"))
    out = rs_.announcements(rs_.parse(p, "announcement")).withColumnRenamed("disclosed_at", "disclosed")
    return dated(out, "disclosed")


@query("2.1.26", f"""SELECT 'C' || o_custkey AS symbol, {day("CASE o_orderkey % 3 WHEN 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 2 DAY END", 'disclosed')}, {day("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 9 DAY END", 'meeting_date')},
      CASE o_orderkey % 2 WHEN 0 THEN 'Financial Results' ELSE 'Dividend' END AS purpose, 'to consider ' || o_orderkey AS description FROM orders WHERE o_orderkey % 3 < 2""")
def board_meetings_ingest(spark, sf):
    k, ts = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    p = order_payload(spark, sf, F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.when(k % 5 != 0, F.date_format(F.date_add(ts, 9), "dd-MMM-yyyy")).otherwise("-").alias("bm_date"),
                      F.when(k % 2 == 0, "Financial Results").otherwise(" Dividend").alias("bm_purpose"), F.concat(F.lit("to consider "), k).alias("bm_desc"),
                      F.when(k % 3 == 0, F.date_format(ts, "dd-MMM-yyyy HH:mm")).alias("bm_timestamp"), F.when(k % 3 == 1, F.date_format(F.date_add(ts, 2), "yyyy-MM-dd")).otherwise("-").alias("exchdisstime"))
    out = rs_.board_meetings(rs_.parse(p, "board_meeting")).withColumnRenamed("disclosed_at", "disclosed")
    return dated(out, "disclosed", "meeting_date")


@query("2.1.26", f"""SELECT 'C' || o_custkey AS symbol, {day("o_orderdate + to_days(CAST(3 + o_orderkey % 4 AS INTEGER))", 'disclosed')}, 'holder ' || o_orderkey AS acquirer, CASE WHEN o_orderkey % 2 = 0 THEN 'Market Purchase' END AS mode,
      {r('o_totalprice', 'shares_after')}, {r('CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 / 8.0 END', 'pct_after')}, {day('o_orderdate', 'from_date')}, {day('o_orderdate + INTERVAL 2 DAY', 'to_date')}, '7(2)' AS regulation
      FROM orders WHERE o_orderkey % 4 < 3""")
def insider_deals_ingest(spark, sf):
    """Dated by what made them known; a row with nothing but the day of the deal is undated."""
    k, ts = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    p = order_payload(spark, sf, F.concat(F.lit("C"), "o_custkey").alias("symbol"), F.concat(F.lit("holder "), k).alias("acqName"), F.when(k % 2 == 0, "Market Purchase").otherwise("").alias("acqMode"),
                      F.col("o_totalprice").cast("string").alias("afterAcqSharesNo"), F.when(k % 5 != 0, (k % 100 / 8.0).cast("string")).otherwise("-").alias("afterAcqSharesPer"),
                      F.date_format(ts, "dd-MMM-yyyy").alias("acqfromDt"), F.date_format(F.date_add(ts, 2), "dd-MMM-yyyy").alias("acqtoDt"),
                      F.when(k % 4 == 0, F.date_format(F.date_add(ts, 3), "dd-MMM-yyyy HH:mm")).alias("date"), F.when(k % 4 == 1, F.date_format(F.date_add(ts, 4), "yyyy-MM-dd")).alias("exchdisstime"),
                      F.when(k % 4 == 2, F.date_format(F.date_add(ts, 5), "dd-MMM-yyyy")).otherwise("NA").alias("intimDt"), F.lit("7(2)").alias("anex"))
    out = rs_.insider_deals(rs_.parse(p, "insider_deal")).withColumnRenamed("disclosed_at", "disclosed")
    return dated(rounded(out, "shares_after", "pct_after"), "disclosed", "from_date", "to_date")


def event_payload(spark, sf):
    o, k = t.table(spark, sf, "orders"), F.col("o_orderkey")
    row = F.struct(F.when(k % 11 != 0, F.concat(F.lit("C"), "o_custkey")).otherwise(" ").alias("symbol"), F.lit("co").alias("company"),
                   F.when(k % 3 == 0, "Financial Results").when(k % 3 == 1, "Dividend").otherwise("Other business").alias("purpose"), F.lit("to consider").alias("bm_desc"),
                   F.when(k % 7 != 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise("soon").alias("date"))
    return o.groupBy(F.floor(k / 16).alias("b")).agg(F.to_json(F.collect_list(row)).alias("body")).select("body")


EV = "evs AS (SELECT 'C' || o_custkey AS symbol, CAST(o_orderdate AS DATE) AS event_date, CASE o_orderkey % 3 WHEN 0 THEN 'Financial Results' WHEN 1 THEN 'Dividend' ELSE 'Other business' END AS purpose FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0)"


@query("2.1.27", sql(f"SELECT symbol, {day('event_date', 'event_date')}, purpose FROM evs", EV))
def event_calendar_ingest(spark, sf):
    return dated(rs_.events(rs_.parse(event_payload(spark, sf), "event")).drop("description"), "event_date")


@query("2.3.7 2.2.18", sql(f"""SELECT symbol, {day('as_of', 'as_of')}, {day('e', 'event_date')}, CAST(date_diff('day', as_of, e) AS DOUBLE) AS days_until, CAST(symbol IN (SELECT symbol FROM evs) AS INTEGER) AS known, CAST(coalesce(date_diff('day', as_of, e) <= 5, false) AS INTEGER) AS blocks
      FROM (SELECT symbol, as_of, (SELECT min(event_date) FROM evs WHERE evs.symbol = a.symbol AND purpose <> 'Other business' AND event_date >= as_of) AS e FROM (SELECT 'C' || c_custkey AS symbol, DATE '1996-01-10' + CAST(c_custkey % 900 AS INTEGER) AS as_of FROM customer) a)""", EV))
def event_windows(spark, sf):
    e = rs_.events(rs_.parse(event_payload(spark, sf), "event")).withColumn("moving", ev.is_price_moving("purpose", "description"))
    asks = t.table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), F.expr("date_add(date'1996-01-10', cast(c_custkey % 900 as int))").alias("as_of"), F.col("c_custkey").alias("ask"))
    w = ev.next_event(asks, e)
    w = w.select("symbol", "as_of", "event_date", F.col("days_until").cast("double").alias("days_until"), F.col("known").cast("int").alias("known"), ev.blocks(5).cast("int").alias("blocks"))
    return dated(w, "as_of", "event_date")


@query("2.4.29", sql("SELECT count(*) FILTER ('C' || c_custkey IN (SELECT symbol FROM evs)) AS known, count(*) AS asked FROM customer", EV))
def event_coverage(spark, sf):
    e = rs_.events(rs_.parse(event_payload(spark, sf), "event"))
    return ev.coverage(t.table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit(".NS")).alias("symbol")), e)


@query("2.1.35 2.1.36 2.12.3", """SELECT event_id, CAST(a BETWEEN 0 AND 3 AS INTEGER) AS fresh_calendar, CAST(h BETWEEN -1 AND 18 AS INTEGER) AS fresh_news FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), CAST(ts AS DATE) + CAST(user_id % 7 - 2 AS INTEGER)) AS a,
      (user_id % 30 - 5) * 1.0 AS h FROM events)""")
def snapshot_staleness(spark, sf):
    e = t.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    e = e.withColumns({"as_of": F.expr("date_add(to_date(ts), cast(user_id % 7 - 2 as int))"), "now": F.expr("ts + make_dt_interval(0, cast(user_id % 30 - 5 as int))")})
    return e.select("event_id", ev.fresh_snapshot("ts", "as_of").cast("int").alias("fresh_calendar"), ev.fresh_news("ts", "now").cast("int").alias("fresh_news"))


# ---- XML filings and feeds ----------------------------------------------

def xbrl_docs(spark, sf):
    f = t.filings(spark, sf).where("nature <> 'unknown'")
    el = lambda tag, c, ctx="OneD": F.concat(F.lit(f'<in-fin:{tag} contextRef="{ctx}" unitRef="INR" decimals="-5">'), F.col(c).cast("string") if isinstance(c, str) else c, F.lit(f"</in-fin:{tag}>\n"))
    nature = F.when(F.col("nature") == "consolidated", "Consolidated").otherwise("Standalone")
    xml = F.concat(F.lit('<?xml version="1.0"?><xbrli:xbrl><xbrli:context id="OneD"><xbrli:period><xbrli:startDate>1990-01-01</xbrli:startDate></xbrli:period></xbrli:context>\n'),
                   el("DateOfStartOfReportingPeriod", "period_start"), el("DateOfEndOfReportingPeriod", "period_end"), el("NatureOfReportStandaloneConsolidated", nature),
                   el("TaxExpense", F.lit(-1.0)), el("RevenueFromOperations", "revenue"), el("BasicEarningsLossPerShareFromContinuingAndDiscontinuedOperations", "eps_basic"),
                   F.concat(F.lit("<in-fin:FinanceCosts decimals='-5' contextRef='OneD'>"), F.col("finance_costs").cast("string"), F.lit("</in-fin:FinanceCosts>")),
                   el("WhetherResultsAreAuditedOrUnaudited", F.when(F.col("nature") == "consolidated", "Audited").otherwise("Unaudited")), el("ProfitLossForPeriod", "profit_after_tax"), el("TaxExpense", "tax_expense"), el("SegmentRevenue", "revenue", "Seg1"), F.lit("</xbrli:xbrl>"))
    return f.select(F.concat_ws("/", "symbol", "period_start", "nature").alias("doc"), xml.alias("xml"))


from .fundamental import FIL, M  # noqa: E402


@query("2.1.28 2.11.11 2.11.13 2.11.16", sql(f"""SELECT symbol || '/' || strftime(period_start, '%Y-%m-%d') || '/' || nature AS doc, {day('period_start', 'period_start')}, {day('period_end', 'period_end')}, 3 AS months, CAST(nature = 'consolidated' AS INTEGER) AS consolidated,
      {r('revenue', 'revenue')}, {r('profit_after_tax', 'profit_after_tax')}, {r('tax_expense', 'tax_fact')}, {r(M('profit_after_tax', 'revenue'), 'net_margin_pct')}, {r('eps_basic', 'eps_basic')}, {r('finance_costs', 'finance_costs')}, CAST(nature = 'consolidated' AS INTEGER) AS audited FROM filings WHERE nature <> 'unknown'""", FIL))
def xbrl_ingest(spark, sf):
    from ..operators.fundamentals import net_margin
    p = rs_.xbrl_periods(rs_.xbrl_facts(xbrl_docs(spark, sf), "doc", "xml"), "doc")
    p = p.select("doc", "period_start", "period_end", "months", F.col("consolidated").cast("int").alias("consolidated"), "revenue", "profit_after_tax",
                 F.try_element_at("facts", F.lit("TaxExpense")).alias("tax_fact"), net_margin("profit_after_tax", "revenue").alias("net_margin_pct"),
                 "eps_basic", "finance_costs", F.col("audited").cast("int").alias("audited"))
    return dated(rounded(p, "revenue", "profit_after_tax", "tax_fact", "net_margin_pct", "eps_basic", "finance_costs"), "period_start", "period_end")


@query("2.1.28", sql("SELECT symbol || '/' || strftime(period_start, '%Y-%m-%d') || '/' || nature AS doc, 1 AS skipped FROM filings WHERE nature <> 'unknown'", FIL))
def xbrl_skipped(spark, sf):
    return rs_.skipped_contexts(rs_.xbrl_facts(xbrl_docs(spark, sf), "doc", "xml"), "doc").withColumn("skipped", F.col("skipped").cast("int"))


def headlines(spark, sf):
    """Every line of every document as a headline, numbered in the order of document and line."""
    d = t.table(spark, sf, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "title")).select(
        (F.col("doc_id") * 1048576 + F.col("line")).alias("item_id"), "title", "source",
        F.expr("timestamp'2026-01-01' + make_dt_interval(0, 0, cast(doc_id as int))").alias("published_at"), (F.col("doc_id") % 4 + 1).cast("int").alias("tier"))


HEAD = """hl AS (SELECT doc_id * 1048576 + k - 1 AS item_id, doc_id, source, lines[k] AS title
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents))"""


@query("2.1.29", sql("""SELECT item_id, trim(replace(replace(title, '<', ' '), '>', ' ')) AS title,
      CASE WHEN item_id % 9 <> 0 THEN strftime(TIMESTAMP '2026-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M') END AS published,
      CASE WHEN trim(replace(replace(title, '<', ' '), '>', ' ')) = '' THEN 'no title' WHEN item_id % 9 = 0 THEN 'no usable time' END AS caveat FROM hl""", HEAD))
def rss_ingest(spark, sf):
    """Feeds of all lines; every other item has attributes, and ampersands come bare, named and as numbers."""
    h = headlines(spark, sf).withColumn("title", F.replace(F.replace("title", F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" ")))
    written = F.when(F.col("item_id") % 3 == 0, F.replace("title", F.lit("&"), F.lit("&amp;"))).when(F.col("item_id") % 3 == 1, F.replace("title", F.lit("&"), F.lit("&#38;"))).otherwise(F.col("title"))
    item = F.concat(F.when(F.col("item_id") % 2 == 0, F.lit("<item>")).otherwise(F.lit('<item id="1">')), F.lit("<title>"), written, F.lit("</title><link>"), F.col("item_id").cast("string"), F.lit("</link><pubDate>"),
                    F.when(F.col("item_id") % 9 == 0, "soon").otherwise(F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss +0000")), F.lit("</pubDate><description>&lt;b&gt;x&lt;/b&gt; & y</description></item>"))
    feed = h.groupBy("source", F.floor(F.col("item_id") / 1048576 / 64).alias("b")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("body"))
    p = news.parse_rss(feed.select("source", "body"))
    return p.select(F.col("link").cast("long").alias("item_id"), F.coalesce("title", F.lit("")).alias("title"), F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"), "caveat")


NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^\\x00-\\x7f]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("2.11.3", sql(f"SELECT item_id, {NORM} AS norm FROM hl", HEAD))
def headline_normalised(spark, sf):
    return headlines(spark, sf).select("item_id", news.normalise("title").alias("norm"))


STOP = "[" + ", ".join(f"'{w}'" for w in news.STOPWORDS) + "]"


@query("2.11.4 2.11.5 2.11.6", sql(f"""SELECT a.item_id, len(a.t) AS tokens, {r('CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) ELSE 0 END', 'similarity')},
        CAST(NOT (list_has_any(a.t, {list(news.UP)}) AND list_has_any(a.t, {list(news.DOWN)})) AND NOT (list_has_any(b.t, {list(news.UP)}) AND list_has_any(b.t, {list(news.DOWN)}))
          AND (list_has_any(a.t, {list(news.UP)}) AND list_has_any(b.t, {list(news.DOWN)}) OR list_has_any(a.t, {list(news.DOWN)}) AND list_has_any(b.t, {list(news.UP)})) AS INTEGER) AS opposed
      FROM tk a JOIN tk b ON b.item_id = a.item_id + 1""", HEAD,
      f"tk AS (SELECT item_id, list_distinct(list_filter(string_split({NORM}, ' '), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))) AS t FROM hl)"))
def headline_similarity(spark, sf):
    """Each line beside the next line of its document: shared words, and whether one says up and the other down."""
    h = headlines(spark, sf).select("item_id", news.tokens("title").alias("t"))
    nxt = h.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return h.join(nxt, "item_id").select("item_id", F.size("t").cast("long").alias("tokens"), r6(news.jaccard(F.col("t"), F.col("u")), "similarity"),
                                         news.opposed(F.col("t"), F.col("u")).cast("int").alias("opposed"))


@query("2.11.8", sql("""SELECT norm, min(item_id) AS item_id, count(*) AS items, min(doc_id % 4 + 1) AS tier, count(DISTINCT source) AS sources, CAST(CASE min(doc_id % 4 + 1) WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 WHEN 3 THEN 0.35 ELSE 0.2 END AS DOUBLE) AS weight
      FROM (SELECT *, """ + NORM + """ AS norm FROM hl) GROUP BY norm""", HEAD))
def story_groups(spark, sf):
    g = news.exact_groups(headlines(spark, sf))
    return g.select("norm", F.col("first.item_id").alias("item_id"), "items", F.col("tier").cast("long").alias("tier"), F.size("sources").cast("long").alias("sources"), news.weight("tier").alias("weight"))


@query("2.11.7 2.11.8")
def story_clusters(spark, sf):
    return news.cluster(headlines(spark, sf))


@query("2.11.9", """SELECT event_id, CASE WHEN t < '09:15:00' THEN 'before_market' WHEN t <= '15:30:00' THEN 'during_market' ELSE 'after_hours' END AS phase FROM (SELECT event_id, strftime(ts + INTERVAL '5 hours 30 minutes', '%H:%M:%S') AS t FROM events)""")
def disclosure_phase(spark, sf):
    return t.table(spark, sf, "events").select("event_id", news.session_phase(F.col("ts").cast("timestamp")).alias("phase"))


# ---- intraday ------------------------------------------------------------

@query("2.1.30", sql(f"""SELECT symbol, strftime(bar_ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%d') AS session, strftime(bar_ts, '%H:%M') AS bar, {r('close', 'close')} FROM hours WHERE volume % 4 <> 0 AND NOT (volume % 5 = 0 AND high > low)""", HOURS))
def chart_block_ingest(spark, sf):
    h, v = t.hour_bars(spark, sf), F.col("volume")
    flip = v % 5 == 0
    h = h.withColumns({"ts": F.unix_timestamp(F.col("bar_ts").cast("timestamp")), "hi": F.when(flip, F.col("low")).otherwise(F.col("high")), "lo": F.when(flip, F.col("high")).otherwise(F.col("low")),
                       "cl": F.when(v % 4 != 0, F.col("close"))})
    items = F.array_sort(F.collect_list(F.struct("ts", "open", "hi", "lo", "cl", "volume")))
    b = h.groupBy("symbol", "session").agg(items.alias("x"))
    pick = lambda f: F.transform("x", lambda s: s[f])
    blocks = b.select("symbol", F.lit(19800).alias("gmtoffset"), pick("ts").alias("ts"), pick("open").alias("open"), pick("hi").alias("high"), pick("lo").alias("low"), pick("cl").alias("close"), pick("volume").alias("volume"))
    out = fl.chart_block(blocks).withColumn("bar", F.date_format("bar_ts", "HH:mm"))
    return show(out, "close", keep=("symbol", "session", "bar"))


@query("2.1.31", sql(f"""SELECT symbol, {day('session')}, strftime(bar_ts, '%H:%M') AS bar, {r("CASE WHEN symbol IN ('click', 'view') AND session >= DATE '2024-01-10' THEN close * 2 ELSE close END", 'close')} FROM hours
      WHERE NOT (symbol IN ('click', 'view') AND session >= DATE '2024-01-10' AND volume < 2)""", HOURS))
def intraday_upsert(spark, sf):
    h = t.hour_bars(spark, sf)
    again = h.where("symbol IN ('click', 'view') AND session >= date'2024-01-10'")
    fetched = again.where("volume >= 2").withColumn("close", F.col("close") * 2)
    stored = h.join(again.select("session", "symbol").distinct().join(fetched.select("session", "symbol").distinct(), ["session", "symbol"], "left_anti"), ["session", "symbol"], "left_anti")
    out = fl.upsert_session(stored, fetched).withColumn("bar", F.date_format("bar_ts", "HH:mm"))
    return show(out, "close", keep=("symbol", "session", "bar"))


@query("2.4.17", sql(f"""SELECT symbol, {day('session')}, count(*) AS bars, strftime(min(bar_ts), '%H:%M') AS first, strftime(max(bar_ts), '%H:%M') AS last, CAST(count(*) >= 20 AS INTEGER) AS complete FROM hours GROUP BY symbol, session""", HOURS))
def session_quality(spark, sf):
    g = t.hour_bars(spark, sf).groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("bars"), F.date_format(F.min("bar_ts"), "HH:mm").alias("first"), F.date_format(F.max("bar_ts"), "HH:mm").alias("last"))
    return dated(g.withColumn("complete", (F.col("bars") >= 20).cast("int")), "session")


@query("2.4.18", sql(f"""SELECT symbol, {r('quantile_cont(br, 0.5)', 'bar_range_p50')}, {r('quantile_cont(br, 0.9)', 'bar_range_p90')}, {r('any_value(sp)', 'session_range_p50')}, {r('any_value(up)', 'up_p50')}, {r('any_value(reach)', 'reach_2x_stop')} FROM (SELECT symbol, 100 * (high - low) / nullif(open, 0) AS br FROM hours)
      JOIN (SELECT symbol, quantile_cont(100 * (h - l) / o, 0.5) AS sp, quantile_cont(100 * (h - o) / o, 0.5) AS up, avg(CASE WHEN 100 * (h - o) / o >= 2 * 40 THEN 1.0 ELSE 0 END) AS reach FROM
        (SELECT symbol, session, arg_min(open, bar_ts) AS o, max(high) AS h, min(low) AS l FROM hours GROUP BY ALL) WHERE o <> 0 GROUP BY symbol) USING (symbol) GROUP BY symbol""", HOURS))
def intraday_scale(spark, sf):
    h = t.hour_bars(spark, sf)
    bar = h.groupBy("symbol").agg(F.percentile(100 * (F.col("high") - F.col("low")) / F.nullif("open", F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    s = h.groupBy("symbol", "session").agg(F.min_by("open", "bar_ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l")).where("o != 0")
    up = 100 * (F.col("h") - F.col("o")) / F.col("o")
    s = s.groupBy("symbol").agg(F.percentile(100 * (F.col("h") - F.col("l")) / F.col("o"), 0.5).alias("session_range_p50"), F.percentile(up, 0.5).alias("up_p50"), F.avg((up >= 80).cast("double")).alias("reach_2x_stop"))
    out = bar.join(s, "symbol").select("symbol", F.col("q")[0].alias("bar_range_p50"), F.col("q")[1].alias("bar_range_p90"), "session_range_p50", "up_p50", "reach_2x_stop")
    return rounded(out, *out.columns[1:])


@query("2.10.3", sql(f"""SELECT symbol, {day('session')}, count(*) AS bars FROM hours WHERE symbol IN (SELECT symbol FROM hours GROUP BY symbol ORDER BY count(*) DESC, symbol LIMIT 2) GROUP BY symbol, session""", HOURS))
def most_active_symbols(spark, sf):
    h = t.hour_bars(spark, sf)
    top = h.groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(2).select("symbol")
    return dated(h.join(top, "symbol", "left_semi").groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("bars")), "session")


@query("2.1.37", sql(f"SELECT symbol, {day('session')}, {r('open', 'open')}, {r('close', 'close')} FROM bars0", supp()))
def plain_csv_bars(spark, sf):
    b = t.bars(spark, sf, index=False)
    line = F.concat_ws(",", "symbol", F.date_format("session", "yyyy-MM-dd"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")])
    raw = fl.split_lines(b.select(line.alias("line")), "line", ("symbol", "Date", "Open", "HIGH", "Low", "Close", "Volume"))
    return show(fl.daily_bars(raw), "open", "close")


@query("2.11.12", f"""SELECT o_orderkey, {r('CASE WHEN o_totalprice / 1e5 - 1 > 0.01 THEN 100.0 / (o_totalprice / 1e5 - 1) END', 'guarded')}, {r('CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / (o_orderkey % 6) END', 'safe')} FROM orders""")
def guarded_division(spark, sf):
    from ..functions.scalars import price, ratio
    o = t.table(spark, sf, "orders")
    return o.select("o_orderkey", r6(100.0 / price(F.col("o_totalprice") / 1e5 - 1), "guarded"), r6(ratio("o_totalprice", F.col("o_orderkey") % 6), "safe"))


@query("2.3.14", sql(f"""SELECT a.symbol, {day('a.session')}, count(b.idx) AS bars_ahead, {r('max(b.high)', 'high_ahead')}, {r('min(b.low)', 'low_ahead')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS idx FROM bars0) a
      LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS idx FROM bars0) b ON b.symbol = a.symbol AND b.idx BETWEEN a.idx + 1 AND a.idx + 5 GROUP BY a.symbol, a.session""", supp()))
def forward_bars(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(1, 5)
    b = t.bars(spark, sf, index=False).withColumns({"bars_ahead": F.count("high").over(w), "high_ahead": F.max("high").over(w), "low_ahead": F.min("low").over(w)})
    return show(b, "bars_ahead", "high_ahead", "low_ahead")
