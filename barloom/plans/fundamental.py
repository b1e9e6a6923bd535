"""Filings, fundamentals, valuation and option spread queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import fundamentals as fd, options as op, ranking
from . import tables as t
from .indicators import show
from .oracle import brand, day, r, sql, supp
from .registry import query
from .scans import dated, rounded

FIL = """filings AS (SELECT *, profit_after_tax / 1e6 AS eps_basic, n * 1e5 AS paid_up_capital, CASE WHEN n % 11 <> 0 THEN 10.0 END AS face_value, profit_after_tax * 1.3 AS profit_before_tax,
      revenue * 0.02 AS finance_costs, revenue * 0.03 AS depreciation, profit_after_tax * 0.3 AS tax_expense,
      CAST(period_start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, period_start + INTERVAL 3 MONTH + INTERVAL 29 DAY + INTERVAL 12 HOUR AS disclosed_at
    FROM (SELECT 'N' || c_nationkey AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period_start,
        CASE o_orderstatus WHEN 'F' THEN 'consolidated' WHEN 'O' THEN 'standalone' ELSE 'unknown' END AS nature,
        sum(o_totalprice) AS revenue, count(*) AS n, sum(o_totalprice * (o_orderkey % 7 - 2) / 50) AS profit_after_tax
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL))"""
AS_OF = "1997-08-20"
KNOWN = f"known AS (SELECT * FROM filings WHERE disclosed_at <= TIMESTAMP '{AS_OF} 09:15:00')"


@query("2.1.33 2.3.1", sql(f"""SELECT symbol, strftime(disclosed_at, '%Y-%m-%d') AS disclosed, nature, {r('revenue', 'revenue')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol
      ORDER BY disclosed_at DESC, period_end DESC, nature DESC) AS k FROM known) WHERE k = 1""", FIL, KNOWN))
def latest_filings(spark, sf):
    f = fd.latest_filing(t.filings(spark, sf), AS_OF)
    return rounded(f.select("symbol", F.date_format("disclosed_at", "yyyy-MM-dd").alias("disclosed"), "nature", "revenue"), "revenue")


ASKS = "asks AS (SELECT DISTINCT 'N' || c_nationkey AS symbol, CAST(o_orderdate AS DATE) AS as_of FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT')"


@query("2.3.1", sql(f"""SELECT a.symbol, {day('a.as_of', 'as_of')}, strftime(c.disclosed_at, '%Y-%m-%d') AS disclosed, {r('c.revenue', 'revenue')}
      FROM asks a ASOF LEFT JOIN (SELECT * FROM filings WHERE nature = 'consolidated') c ON c.symbol = a.symbol AND c.disclosed_at <= a.as_of + INTERVAL 9 HOUR + INTERVAL 15 MINUTE""", FIL, ASKS))
def filings_as_of(spark, sf):
    o, c = t.table(spark, sf, "orders"), t.table(spark, sf, "customer")
    asks = (o.where("o_orderpriority = '1-URGENT'").join(c, o.o_custkey == c.c_custkey)
            .select(F.concat(F.lit("N"), "c_nationkey").alias("symbol"), F.to_date("o_orderdate").alias("as_of")).distinct())
    out = fd.latest_as_of(asks, t.filings(spark, sf).where("nature = 'consolidated'"), "revenue")
    return dated(rounded(out.select("symbol", "as_of", F.date_format("disclosed_at", "yyyy-MM-dd").alias("disclosed"), "revenue"), "revenue"), "as_of")


CMP = ["cq AS (SELECT *, max(period_end) OVER (PARTITION BY symbol, nature) AS ce FROM known WHERE nature <> 'unknown')",
       """pair AS (SELECT c.*, p.revenue AS rev0, p.profit_after_tax AS pat0, p.period_end AS pe0, CASE c.nature WHEN 'consolidated' THEN 0 ELSE 1 END AS nr FROM cq c
            LEFT JOIN cq p ON p.symbol = c.symbol AND p.nature = c.nature AND p.period_end < c.ce AND abs(date_diff('day', p.period_end, c.ce) - 365) <= 45 WHERE c.period_end = c.ce)""",
       "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN pe0 IS NULL THEN 1 ELSE 0 END, nr, pe0) AS k FROM pair) WHERE k = 1)"]
G = lambda a, b: f"CASE WHEN {b} > 0 THEN 100 * ({a} - {b}) / {b} END"
M = lambda p, v: f"100 * {p} / nullif({v}, 0)"


@query("2.8.1 2.8.2 2.8.3 2.8.6 2.11.16", sql(f"""SELECT symbol, nature, {day('period_end', 'period_end')}, {r(M('profit_after_tax', 'revenue'), 'net_margin_pct')},
      {r(G('revenue', 'rev0'), 'revenue_growth_yoy_pct')}, {r(G('profit_after_tax', 'pat0'), 'profit_growth_yoy_pct')}, {r(M('profit_after_tax', 'revenue') + ' - ' + M('pat0', 'rev0'), 'margin_change_pp')},
      date_diff('day', CAST((SELECT max(disclosed_at) FROM known k WHERE k.symbol = best.symbol) AS DATE), DATE '{AS_OF}') AS days_since_filing,
      CASE WHEN pe0 IS NULL THEN 'no year-ago comparison' ELSE 'complete' END AS coverage, {r('paid_up_capital / face_value', 'shares_outstanding')}, {r('profit_before_tax + finance_costs', 'ebit')},
      {r('100 * (profit_before_tax + finance_costs) / revenue', 'op_margin_pct')}, {r('CASE WHEN profit_before_tax > 0 THEN 100 * tax_expense / profit_before_tax END', 'effective_tax_rate_pct')},
      {r('(profit_before_tax + finance_costs) / finance_costs', 'interest_cover')}, {r('revenue', 'revenue')}, {r('profit_after_tax', 'profit_after_tax')},
      {r('profit_before_tax + finance_costs + depreciation', 'ebitda')}, {r('CASE WHEN profit_before_tax > 0 THEN (profit_before_tax + finance_costs) * (1 - 100 * tax_expense / profit_before_tax / 100) END', 'nopat')}
      FROM best""", FIL, KNOWN, CMP))
def fundamentals_table(spark, sf):
    b = fd.build_table(t.filings(spark, sf), AS_OF).drop("industry")
    b = b.withColumn("days_since_filing", F.col("days_since_filing").cast("long"))
    return dated(rounded(b, *[c for c, ty in b.dtypes if ty == "double"]), "period_end")


@query("2.4.24", sql("""SELECT coalesce(cov, 'no filings on file') AS reason, count(*) AS symbols FROM (SELECT DISTINCT upper('N' || s_nationkey) AS b FROM supplier UNION ALL SELECT 'N99') a
      LEFT JOIN (SELECT symbol AS b, CASE WHEN pe0 IS NULL THEN 'no year-ago comparison' ELSE 'complete' END AS cov FROM best) USING (b) GROUP BY ALL""", FIL, KNOWN, CMP))
def fundamentals_coverage(spark, sf):
    s = t.table(spark, sf, "supplier").select(F.concat(F.lit("n"), "s_nationkey", F.lit(".NS")).alias("symbol")).distinct()
    extra = s.limit(1).select(F.lit("N99.NS").alias("symbol"))
    return fd.coverage_counts(s.union(extra), t.filings(spark, sf), AS_OF)


# filings that hold the year to date beside the quarter; the quarters are told from it by their days alone
SPANS = """spans AS (SELECT * FROM filings UNION ALL SELECT symbol, CAST(date_trunc('year', period_start) AS DATE) AS period_start, nature, ytd_rev AS revenue, ytd_n AS n, ytd_pat AS profit_after_tax,
      ytd_pat / 1e6, ytd_n * 1e5, CASE WHEN ytd_n % 11 <> 0 THEN 10.0 END, ytd_pat * 1.3, ytd_rev * 0.02, ytd_rev * 0.03, ytd_pat * 0.3, period_end, disclosed_at
    FROM (SELECT *, sum(revenue) OVER w AS ytd_rev, CAST(sum(n) OVER w AS BIGINT) AS ytd_n, sum(profit_after_tax) OVER w AS ytd_pat FROM filings
          WINDOW w AS (PARTITION BY symbol, nature, year(period_start) ORDER BY period_start)) WHERE month(period_start) > 1)"""
MONTHS_SQL = "greatest(1, CAST(round((date_diff('day', period_start, period_end) + 1) / 30.44) AS INTEGER))"


@query("2.1.33 2.3.1", sql(f"""SELECT months, symbol, strftime(disclosed_at, '%Y-%m-%d') AS disclosed, nature, {day('period_start', 'period_start')}, {r('revenue', 'revenue')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, months
      ORDER BY disclosed_at DESC, period_end DESC, nature DESC) AS k FROM (SELECT *, {MONTHS_SQL} AS months FROM spans) WHERE disclosed_at <= TIMESTAMP '{AS_OF} 09:15:00' AND months IN (3, 9, 12)) WHERE k = 1""", FIL, SPANS))
def latest_filings_by_length(spark, sf):
    """The newest filing with a quarter, with nine months, with a year, of each symbol."""
    f = t.filings(spark, sf, year_to_date=True)
    out = [fd.latest_filing(f, AS_OF, m).withColumn("months", F.lit(m)) for m in (3, 9, 12)]
    out = out[0].unionByName(out[1]).unionByName(out[2])
    return dated(rounded(out.select("months", "symbol", F.date_format("disclosed_at", "yyyy-MM-dd").alias("disclosed"), "nature", "period_start", "revenue"), "revenue"), "period_start")


@query("2.8.1 2.8.2", sql(f"""SELECT symbol, symbol AS industry, nature, {day('period_end', 'period_end')}, {r('revenue', 'revenue')}, {r(G('revenue', 'rev0'), 'revenue_growth_yoy_pct')},
      {r(G('profit_after_tax', 'pat0'), 'profit_growth_yoy_pct')} FROM best WHERE symbol <> 'N5' UNION ALL SELECT symbol, NULL, nature, {day('period_end', 'period_end')}, {r('revenue', 'revenue')},
      {r(G('revenue', 'rev0'), 'revenue_growth_yoy_pct')}, {r(G('profit_after_tax', 'pat0'), 'profit_growth_yoy_pct')} FROM best WHERE symbol = 'N5'""", FIL, KNOWN, CMP))
def fundamentals_beside_year_to_date(spark, sf):
    """The table from filings that hold the year to date too: the same quarters are compared, with their industry."""
    n = t.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".NS")).alias("symbol"), F.concat(F.lit("N"), "n_nationkey").alias("industry")).where("industry <> 'N5'")
    b = fd.build_table(t.filings(spark, sf, year_to_date=True), AS_OF, n)
    b = b.select("symbol", "industry", "nature", "period_end", "revenue", "revenue_growth_yoy_pct", "profit_growth_yoy_pct")
    return dated(rounded(b, "revenue", "revenue_growth_yoy_pct", "profit_growth_yoy_pct"), "period_end")


def patchy_filings(spark, sf):
    """Filings of which some names have only the year to date, some no nature, some a body that cannot be read."""
    k = F.substring("symbol", 2, 2).cast("int")
    f = t.filings(spark, sf, year_to_date=True).where((k % 5 != 1) | (fd.period_months() != 3)).where((k % 7 != 2) | (F.col("period_start") >= "1997-01-01"))
    return f.withColumns({"nature": F.when(k % 5 == 2, "unknown").otherwise(F.col("nature")), "unreadable": (k % 5 == 3) & (F.col("n") % 2 == 0)})


@query("2.4.24", sql(f"""SELECT 'N' || n AS base, CASE WHEN broken THEN 'unreadable' WHEN NOT coalesce(q, false) THEN 'no filings on file' WHEN ce IS NULL THEN 'no quarterly numbers' WHEN NOT twin THEN 'no year-ago comparison' ELSE 'complete' END AS reason
      FROM range(30) t(n) LEFT JOIN (SELECT CAST(substr(symbol, 2) AS BIGINT) AS n, bool_or(n % 2 = 0 AND CAST(substr(symbol, 2) AS BIGINT) % 5 = 3) AS broken, bool_or(months = 3) AS q FROM pk GROUP BY ALL) USING (n)
      LEFT JOIN (SELECT CAST(substr(symbol, 2) AS BIGINT) AS n, max(ce) AS ce, bool_or(period_end < ce AND abs(date_diff('day', period_end, ce) - 365) <= 45) AS twin
        FROM (SELECT *, max(period_end) OVER (PARTITION BY symbol, nature) AS ce FROM pk WHERE months = 3 AND nature <> 'unknown' AND CAST(substr(symbol, 2) AS BIGINT) % 5 <> 2) GROUP BY ALL) USING (n)""", FIL, SPANS,
      f"""pk AS (SELECT * FROM (SELECT *, {MONTHS_SQL} AS months FROM spans) WHERE disclosed_at <= TIMESTAMP '{AS_OF} 09:15:00' AND (CAST(substr(symbol, 2) AS BIGINT) % 5 <> 1 OR months <> 3)
            AND (CAST(substr(symbol, 2) AS BIGINT) % 7 <> 2 OR period_start >= DATE '1997-01-01'))"""))
def fundamentals_coverage_reasons(spark, sf):
    asked = spark.range(30).select(F.concat(F.lit("n"), "id", F.lit(".NS")).alias("symbol"))  # the asked names; five have no filings at all
    return fd.coverage_reasons(asked, patchy_filings(spark, sf), AS_OF)


TTM = ["tq AS (SELECT *, row_number() OVER w AS k, date_diff('day', period_end, lag(period_end) OVER w) AS st FROM known WHERE nature <> 'unknown' WINDOW w AS (PARTITION BY symbol, nature ORDER BY period_end DESC))",
       """tg AS (SELECT symbol, nature, max(period_end) AS pe, sum(revenue) AS rev, sum(profit_after_tax) AS pat, sum(eps_basic) AS eps, arg_max(paid_up_capital, period_end) AS pu, arg_max(coalesce(face_value, -1), period_end) AS fv,
            count(*) AS c, max(abs(st - 91)) AS drift FROM tq WHERE k <= 4 GROUP BY ALL)""",
       "ttm AS (SELECT *, CASE WHEN fv > 0 THEN pu / fv END AS sh FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY nature) AS z FROM tg WHERE c = 4 AND drift <= 35) WHERE z = 1)"]


@query("2.8.4", sql(f"SELECT symbol, nature, c AS quarters, {day('pe', 'period_end')}, {r('rev', 'revenue_ttm')}, {r('pat', 'pat_ttm')}, {r('eps', 'eps_ttm')}, {r('sh', 'shares_outstanding')} FROM ttm", FIL, KNOWN, TTM))
def trailing_twelve(spark, sf):
    x = fd.trailing_twelve(fd.known_at(t.filings(spark, sf), AS_OF))
    return dated(rounded(x, "revenue_ttm", "pat_ttm", "eps_ttm", "shares_outstanding"), "period_end")


CLOSES = "px AS (SELECT 'N' || s_nationkey AS symbol, avg(s_acctbal) AS close FROM supplier GROUP BY s_nationkey HAVING avg(s_acctbal) > 0)"


@query("2.8.5 2.8.7", sql(f"""SELECT symbol, {r('mc', 'market_cap')}, {r('CASE WHEN pat > 0 THEN mc / pat END', 'pe_ttm')}, {r('100 * pat / mc', 'earnings_yield_pct')}, {r('mc / rev', 'ps_ttm')},
      CAST(sus AS INTEGER) AS suspect, {r(f"CASE WHEN gr > 0 AND gr <= 100 AND pat > 0 THEN mc / pat / gr END", 'peg')} FROM (SELECT ttm.*, symbol IN ('N3', 'N7') AS sus, CASE WHEN symbol NOT IN ('N3', 'N7') THEN sh * close END AS mc, gr
        FROM ttm JOIN px USING (symbol) LEFT JOIN (SELECT symbol, {G('profit_after_tax', 'pat0')} AS gr FROM best) USING (symbol))""", FIL, KNOWN, TTM, CMP, CLOSES))
def valuation_table(spark, sf):
    f = t.filings(spark, sf)
    s = t.table(spark, sf, "supplier").groupBy(F.concat(F.lit("N"), "s_nationkey").alias("symbol")).agg(F.avg("s_acctbal").alias("close"))
    sus = s.where("symbol IN ('N3', 'N7')")
    v = fd.valuation(fd.trailing_twelve(fd.known_at(f, AS_OF)), s, sus, AS_OF)
    v = v.join(fd.build_table(f, AS_OF).select("symbol", "profit_growth_yoy_pct"), "symbol", "left").withColumn("peg", fd.peg())
    v = v.select("symbol", "market_cap", "pe_ttm", "earnings_yield_pct", "ps_ttm", F.col("share_count_suspect").cast("int").alias("suspect"), "peg")
    return rounded(v, "market_cap", "pe_ttm", "earnings_yield_pct", "ps_ttm", "peg")


@query("2.8.8 2.3.3 2.10.8", sql(f"""SELECT s_suppkey, symbol, CAST(b.period_end IS NOT NULL AS INTEGER) AS checked, {r('mg', 'net_margin_pct')} FROM (SELECT s_suppkey, 'N' || s_nationkey || CASE WHEN s_suppkey % 10 = 0 THEN 'X' ELSE '' END AS symbol FROM supplier) s
      LEFT JOIN (SELECT symbol AS bs, period_end, {M('profit_after_tax', 'revenue')} AS mg FROM best) b ON bs = symbol WHERE NOT coalesce(mg < 2, false)""", FIL, KNOWN, CMP))
def fundamental_filters(spark, sf):
    tail = F.when(F.col("s_suppkey") % 10 == 0, "X").otherwise("")
    s = t.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("n"), "s_nationkey", tail, F.lit(".ns")).alias("symbol"))
    out = ranking.apply_fundamentals(s, fd.build_table(t.filings(spark, sf), AS_OF), 4000, 2.0)
    return rounded(out.select("s_suppkey", F.upper(F.split("symbol", r"\.")[0]).alias("symbol"), F.col("checked").cast("int").alias("checked"), "net_margin_pct"), "net_margin_pct")


@query("2.1.34 2.3.2", sql(f"""SELECT symbol, {day('as_of', 'as_of')}, {r('revenue', 'revenue')}, date_diff('day', as_of, DATE '1998-05-10') AS age_days, CAST(date_diff('day', as_of, DATE '1998-05-10') > 5 AS INTEGER) AS stale
      FROM (SELECT symbol, CAST(date_trunc('quarter', period_end) AS DATE) AS as_of, sum(revenue) AS revenue FROM filings GROUP BY ALL) b WHERE as_of = (SELECT max(CAST(date_trunc('quarter', period_end) AS DATE)) FROM filings WHERE date_trunc('quarter', period_end) <= DATE '1998-05-10')""", FIL))
def cached_build(spark, sf):
    b = t.filings(spark, sf).groupBy("symbol", F.to_date(F.date_trunc("quarter", "period_end")).alias("as_of")).agg(F.sum("revenue").alias("revenue"))
    n = fd.newest_build(b, "1998-05-10")
    return dated(rounded(n.withColumns({"stale": F.col("stale").cast("int"), "age_days": F.col("age_days").cast("long")}), "revenue"), "as_of")


# ---- options -------------------------------------------------------------

CON = """con AS (SELECT *, CAST(1020.0 AS DOUBLE) AS underlying, CAST(25.0 AS DOUBLE) AS lot_size, q AS volume, q * 20 AS open_interest, greatest(away, 0) * 0.6 + 45.0 + away * 0.25 + dc * 60 AS close FROM (
      SELECT *, CASE WHEN option_type = 'CE' THEN 1020.0 - strike ELSE strike - 1020.0 END AS away FROM (
      SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, CAST(date_trunc('month', l_shipdate) AS DATE) + 28 AS expiry,
        CASE WHEN l_orderkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS option_type, CAST(900.0 + floor(l_quantity / 2) * 10 AS DOUBLE) AS strike, max(l_discount) AS dc, count(*) AS k, sum(l_quantity) AS q
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)))"""
SPR = ["""leg AS (SELECT *, count(*) OVER (PARTITION BY trade_date, symbol, expiry, option_type) AS m FROM con WHERE open_interest >= 500 AND volume > 0 AND date_diff('day', trade_date, expiry) BETWEEN 21 AND 35)""",
       "ok AS (SELECT * FROM leg WHERE m >= 3 AND close >= greatest(away, 0) - 0.05)",
       """pr AS (SELECT a.trade_date, a.symbol, a.expiry, a.option_type, a.strike AS k1, b.strike AS k2, CASE WHEN a.option_type = 'CE' THEN a.close - b.close ELSE b.close - a.close END AS premium, b.strike - a.strike AS width
            FROM ok a JOIN ok b USING (trade_date, symbol, expiry, option_type) WHERE a.strike < b.strike)""",
       """sp AS (SELECT *, premium * 25 AS outlay FROM (SELECT *, (width - premium) / premium AS rr, row_number() OVER (PARTITION BY trade_date, symbol, expiry, option_type ORDER BY abs((width - premium) / premium - 2.0), k1, k2) AS n
            FROM pr WHERE premium > 0 AND premium < width AND (width - premium) / premium BETWEEN 1.65 AND 2.35) WHERE n = 1)"""]


@query("2.9.1 2.3.8 2.9.3 2.13.5", sql(f"SELECT symbol, {day('trade_date', 'trade_date')}, option_type, k1, k2, {r('premium', 'premium')}, {r('rr', 'rr')} FROM sp", CON, SPR))
def vertical_spreads(spark, sf):
    s = op.spreads(t.contracts(spark, sf))
    return dated(rounded(s.select("symbol", "trade_date", "option_type", "k1", "k2", "premium", "rr"), "premium", "rr"), "trade_date")


SET = [brand("month", "mb"), "ux AS (SELECT symbol, session + 28 AS session, 1020 * (0.9 + 0.2 * (trades % 10) / 9.0) AS close FROM mb)",
       """tr AS (SELECT sp.*, ux.close AS settle, least(greatest(CASE WHEN option_type = 'CE' THEN ux.close - k1 ELSE k2 - ux.close END, 0), width) - premium AS payoff FROM sp JOIN ux ON ux.symbol = sp.symbol AND ux.session = sp.expiry)""",
       "tt AS (SELECT *, payoff / premium AS r, (2 * 20.0 * 1.18 * 2 + outlay * (0.15 + 0.03503) / 100) / outlay AS cost_r, 100 * (settle / 1020 - 1) AS mv FROM tr)"]


def settled(spark, sf):
    ux = t.brand_bars(spark, sf, index=False).select("symbol", F.date_add("session", 28).alias("session"),
                                                     (1020 * (0.9 + 0.2 * (F.col("trades") % 10) / 9.0)).alias("close"))
    return op.settle(op.spreads(t.contracts(spark, sf)), ux).withColumn("move_pct", 100 * (F.col("settle") / 1020 - 1))


@query("2.9.2 2.3.10", sql(f"SELECT symbol, {day('trade_date', 'trade_date')}, option_type, {r('settle', 'settle')}, {r('payoff', 'payoff')}, {r('r', 'r')}, {r('cost_r', 'cost_r')} FROM tt", CON, SPR, SET))
def spread_payoffs(spark, sf):
    s = settled(spark, sf).select("symbol", "trade_date", "option_type", "settle", "payoff", "r", "cost_r")
    return dated(rounded(s, "settle", "payoff", "r", "cost_r"), "trade_date")


GROUPS = (("all", "true"), ("bull calls", "option_type = 'CE'"), ("bear puts", "option_type = 'PE'"), ("small outlay", "outlay <= 2000"))


@query("2.4.21", sql(" UNION ALL ".join(f"""SELECT '{n}' AS grp, count(*) AS n, {r('avg(r)', 'gross_r')}, {r('avg(cost_r)', 'cost_r')}, {r('avg(r) - avg(cost_r)', 'net_r')}, {r('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END)', 'win_rate')},
      {r("avg(CASE WHEN CASE WHEN option_type = 'CE' THEN settle >= k2 ELSE settle <= k1 END THEN 1.0 ELSE 0 END)", 'max_profit_rate')}, {r('avg(r) / stddev_samp(r) * sqrt(count(*))', 't_stat')} FROM tt WHERE {c}""" for n, c in GROUPS), CON, SPR, SET))
def spread_report(spark, sf):
    rep = op.report(settled(spark, sf), {n: F.expr(c) for n, c in GROUPS})
    return rounded(rep, *[c for c, ty in rep.dtypes if ty == "double"])


@query("2.4.20", sql(f"""SELECT count(*) AS expiries, {r('avg(mr)', 'mean_r')}, {r('avg(mr) / stddev_samp(mr) * sqrt(count(*))', 't_stat')}, {r('regr_slope(mr, mv)', 'slope')}, {r('regr_intercept(mr, mv)', 'alpha')}, {r('regr_r2(mr, mv)', 'r2')},
      {r('regr_intercept(mr, mv) / sqrt(regr_syy(mr, mv) * (1 - regr_r2(mr, mv)) / (count(*) - 2) * (1.0 / count(*) + avg(mv) ** 2 / regr_sxx(mr, mv)))', 'alpha_t')}
      FROM (SELECT expiry, avg(r) AS mr, avg(mv) AS mv, count(*) AS n FROM tt GROUP BY expiry) WHERE n >= 10""", CON, SPR, SET))
def expiry_level_test(spark, sf):
    e = op.expiry_test(settled(spark, sf), 10)
    return rounded(e, *[c for c, ty in e.dtypes if ty == "double"])


@query("2.2.14", sql(f"""SELECT symbol, count(*) AS rows, {r('avg(CASE WHEN close < greatest(away, 0) - 0.05 THEN 1.0 ELSE 0 END)', 'below_intrinsic')}, {r('avg(CASE WHEN st > 0.05 THEN 1.0 WHEN st IS NOT NULL THEN 0.0 END)', 'non_monotonic')}
      FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol, trade_date, expiry ORDER BY strike) AS st FROM con WHERE option_type = 'CE') GROUP BY symbol""", CON))
def chain_coherence(spark, sf):
    c = t.contracts(spark, sf).withColumn("chain", F.col("symbol")).withColumn("symbol", F.concat_ws("|", "symbol", "trade_date"))
    out = op.coherence(c, keys=["chain"]).withColumnRenamed("chain", "symbol")
    return rounded(out, "below_intrinsic", "non_monotonic")


@query("2.1.16", sql(f"""SELECT {day('trade_date', 'trade_date')}, count(*) AS contracts, {r('count(*) FILTER (volume >= 60) / count(*)', 'traded_share')} FROM con GROUP BY trade_date""", CON))
def traded_share(spark, sf):
    g = op.options_of(t.contracts(spark, sf)).groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("contracts"), (F.count_if(F.col("volume") >= 60) / F.count(F.lit(1))).alias("traded_share"))
    return dated(rounded(g, "traded_share"), "trade_date")


@query("2.1.16", sql(f"SELECT symbol, {day('expiry', 'expiry')}, option_type, strike, {r('close', 'close')} FROM con WHERE symbol = 'Brand#12' AND expiry = DATE '1997-05-29'", CON))
def option_chain(spark, sf):
    c = op.chain(t.contracts(spark, sf), "Brand#12", "1997-05-29").select("symbol", "expiry", "option_type", "strike", "close")
    return dated(rounded(c, "close"), "expiry")
