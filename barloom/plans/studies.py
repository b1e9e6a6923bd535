"""Regimes, pairs, persistence, clusters and multiple-testing studies."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import frames as W
from ..functions.scalars import r6, truth
from ..operators import clusters as cl, metrics, outcomes as oc, pairs as pr, regime as rg, series_stats as ss, setups
from ..session import cut_lineage
from . import tables as t
from .indicators import BW, LAG, gate, layer, prior, rs, show
from .oracle import CAL, brand, day, panel as P, r, sql, supp
from .registry import query
from .scans import dated, rounded

# weekly volume-weighted closes: the ``dense`` matrix with that close
VW = [brand("week", "raw0"), """bars0 AS (SELECT symbol, session, turnover / volume AS close, high, low, open, volume, turnover, trades FROM raw0)""",
      *P("week", lambda g: "zz AS (SELECT 1)")]
MAKERS = "mk AS (SELECT DISTINCT symbol, 'M' || substr(symbol, 7, 1) AS industry FROM bars0)"


def weekly(spark, sf):
    return t.vwap_weeks(spark, sf)


def makers(panel):
    return panel.select("symbol", F.concat(F.lit("M"), F.substring("symbol", 7, 1)).alias("industry")).distinct()


REG = [
    f"b1 AS (SELECT session, count(s) AS cmp, count(*) FILTER (close > s) AS abv FROM (SELECT *, {gate('avg', 'close', 50)} AS s FROM dense) WHERE close IS NOT NULL GROUP BY session)",
    f"c1 AS (SELECT session, coalesce(avg(CASE WHEN abs(ret) <= 0.5 THEN ret END), 0) AS m FROM (SELECT *, close / nullif(lag(close) {LAG}, 0) - 1 AS ret FROM dense) WHERE close IS NOT NULL GROUP BY session)",
    """d1 AS (SELECT c1.session, c.idx, exp(sum(ln(1 + m)) OVER (ORDER BY c.idx)) AS comp, 100.0 * abv / nullif(cmp, 0) AS bp,
          row_number() OVER (ORDER BY c.idx) AS n FROM c1 JOIN cal c USING (session) JOIN b1 USING (session))""",
    "d2 AS (SELECT *, comp / lag(comp) OVER (ORDER BY idx) - 1 AS daily, comp / lag(comp, 20) OVER (ORDER BY idx) - 1 AS chg, max(comp) OVER (ORDER BY idx) AS peak FROM d1)",
    """d3 AS (SELECT *, stddev_samp(daily) OVER (ORDER BY idx ROWS 59 PRECEDING) AS sg,
          CASE WHEN count(daily) OVER (ORDER BY idx ROWS 19 PRECEDING) = 20 THEN stddev_samp(daily) OVER (ORDER BY idx ROWS 19 PRECEDING) END AS vol FROM d2)""",
    """d4 AS (SELECT a.*, 100.0 * (SELECT count(*) FROM d3 b WHERE b.idx <= a.idx AND b.vol <= a.vol) / nullif((SELECT count(vol) FROM d3 b WHERE b.idx <= a.idx), 0) AS vp,
          100 * (comp / peak - 1) AS dd, CASE WHEN sg >= 1e-6 THEN chg / (sg * sqrt(20)) ELSE chg / 0.05 END AS z FROM d3 a)""",
    """d5 AS (SELECT *, CASE WHEN n >= 60 THEN CASE WHEN z >= 1.5 THEN 'strong_up' WHEN z >= 0.4 THEN 'up' WHEN z <= -1.5 THEN 'strong_down' WHEN z <= -0.4 THEN 'down' WHEN z IS NOT NULL THEN 'flat' END END AS trend,
          CASE WHEN n >= 60 AND n - 1 >= 120 THEN CASE WHEN vp >= 95 THEN 'extreme' WHEN vp >= 80 THEN 'elevated' WHEN vp <= 20 THEN 'low' WHEN vp IS NOT NULL THEN 'normal' END END AS volatility,
          CASE WHEN n >= 60 THEN CASE WHEN bp > 60 THEN 'broad' WHEN bp < 40 THEN 'narrow' WHEN bp IS NOT NULL THEN 'neutral' END END AS breadth,
          CASE WHEN n >= 60 THEN CASE WHEN dd <= -10 AND coalesce(bp, 0) < 40 THEN 'risk_off' WHEN dd >= -3 AND bp > 60 THEN 'risk_on' ELSE 'neutral' END END AS risk_appetite FROM d4)""",
    """reg AS (SELECT session, idx, comp, bp, z, vp, dd, coalesce(trend, 'unknown') AS trend, coalesce(volatility, 'unknown') AS volatility, coalesce(breadth, 'unknown') AS breadth,
          coalesce(risk_appetite, 'unknown') AS risk_appetite, CASE WHEN volatility = 'extreme' OR risk_appetite = 'risk_off' THEN 'crisis' WHEN volatility = 'elevated' THEN 'high_vol'
            WHEN trend IN ('strong_up', 'up') THEN 'trending_up' WHEN trend IN ('strong_down', 'down') THEN 'trending_down' WHEN trend = 'flat' THEN 'range' ELSE 'unknown' END AS label FROM d5)"""]


@query("2.4.1 2.4.2 2.4.4 2.4.5 2.4.6 2.4.7 2.4.8", sql(f"""SELECT {day('session')}, {r('comp', 'composite')}, {r('bp', 'breadth_pct')}, {r('z', 'trend_z')}, {r('vp', 'vol_pctile')},
      {r('dd', 'drawdown_pct')}, trend, volatility, breadth, risk_appetite, label FROM reg""", VW, REG))
def market_regime(spark, sf):
    return show(rg.regime_series(cut_lineage(weekly(spark, sf))), "composite", "breadth_pct", "trend_z", "vol_pctile", "drawdown_pct",
                "trend", "volatility", "breadth", "risk_appetite", "label", keep=("session",))


HOSTILE_SQL = """cat AS (SELECT * FROM (VALUES ('supertrend_adx', ['range', 'high_vol'], false), ('bollinger_rsi', ['trending_down', 'crisis'], true),
      ('donchian_breakout', ['range'], true), ('opening_range_breakout', ['range'], false), ('ml_classifier', ['crisis'], false)) c(strategy, hostile, impl))"""


@query("2.6.24 2.2.19 2.6.23", sql(f"""SELECT {day('session')}, strategy, CASE WHEN list_contains(hostile, label) THEN 'silenced' WHEN NOT impl THEN 'unimplemented' ELSE 'proposing' END AS status
      FROM reg, cat""", VW, REG, HOSTILE_SQL))
def strategy_eligibility(spark, sf):
    reg = rg.regime_series(cut_lineage(weekly(spark, sf))).select("session", "label")
    rows = F.array(*[F.struct(F.lit(k).alias("strategy"), F.array(*[F.lit(x) for x in h]).alias("hostile"), F.lit(i).alias("impl"))
                     for k, h, _, i in setups.CATALOGUE])
    d = reg.withColumn("c", F.explode(rows)).select("session", "label", "c.*")
    status = F.when(F.array_contains("hostile", F.col("label")), "silenced").when(~F.col("impl"), "unimplemented").otherwise("proposing")
    return dated(d.select("session", "strategy", status.alias("status")), "session")


@query("2.4.3 2.1.20", sql(f"""SELECT {day('session')}, industry, {r('m', 'median_change')}, n AS names, hi AS lead_rank, lo AS lag_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY session ORDER BY m DESC, industry) AS hi, row_number() OVER (PARTITION BY session ORDER BY m, industry DESC) AS lo FROM (
        SELECT session, industry, median(chg) AS m, count(chg) AS n FROM (SELECT *, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS chg FROM dense) JOIN mk USING (symbol)
        WHERE chg IS NOT NULL GROUP BY ALL) WHERE n >= 3) WHERE hi <= 3 OR lo <= 3""", VW, MAKERS))
def sector_medians(spark, sf):
    p = weekly(spark, sf)
    m = rg.sector_medians(p, makers(p))
    return dated(rounded(m.withColumns({c: F.col(c).cast("long") for c in ("lead_rank", "lag_rank")}), "median_change"), "session")


GATE_SQL = ["ewd AS (SELECT session, avg(close) AS ew FROM bars0 GROUP BY session)",
            "gt AS (SELECT session, c.idx, ew, coalesce(ew > CASE WHEN count(ew) OVER w = 50 THEN avg(ew) OVER w END, false) AS gate FROM ewd JOIN cal c USING (session) WINDOW w AS (ORDER BY c.idx ROWS 49 PRECEDING))"]


@query("2.5.65", sql(f"SELECT {day('session')}, {r('ew', 'ew')}, CAST(gate AS INTEGER) AS gate FROM gt", VW, GATE_SQL))
def index_gate(spark, sf):
    g = rg.index_gate(weekly(spark, sf))
    return show(g.withColumn("gate", F.col("gate").cast("int")), "ew", "gate", keep=("session",))


WIN_SQL = [f"av AS (SELECT session, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) AS adv FROM (SELECT session, close / nullif(lag(close) {LAG}, 0) - 1 AS ret FROM dense) GROUP BY session)",
           "g1 AS (SELECT gt.*, adv, ew / lag(ew) OVER (ORDER BY idx) - 1 AS r FROM gt JOIN av USING (session))",
           "g2 AS (SELECT *, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w * sqrt(52) * 100 END AS vol, idx * 4 // (SELECT count(*) FROM gt) AS win FROM g1 WINDOW w AS (ORDER BY idx ROWS 19 PRECEDING))",
           "wc AS (SELECT win, 100 * avg(adv) AS a, 100 * avg(CASE WHEN gate THEN 1.0 ELSE 0 END) AS b, avg(vol) AS v, 100 * (arg_max(ew, idx) / arg_min(ew, idx) - 1) AS rt FROM g2 GROUP BY win)"]


@query("2.4.22", sql(f'SELECT win AS "window", {r("a", "advance_pct")}, {r("b", "above_pct")}, {r("v", "vol_pct")}, {r("rt", "return_pct")} FROM wc', VW, GATE_SQL, WIN_SQL))
def window_regimes(spark, sf):
    return rounded(rg.window_comparison(weekly(spark, sf), 4, 52), "advance_pct", "above_pct", "vol_pct", "return_pct")


@query("2.4.22", sql(" UNION ALL ".join(f"""SELECT '{n}' AS measure, {r(f'avg({c}) FILTER (rt > 0)', 'good_mean')}, {r(f'avg({c}) FILTER (rt <= 0)', 'bad_mean')},
      CAST(coalesce(min({c}) FILTER (rt > 0) > max({c}) FILTER (rt <= 0), false) OR coalesce(min({c}) FILTER (rt <= 0) > max({c}) FILTER (rt > 0), false) AS INTEGER) AS clean FROM wc"""
      for n, c in (("advance_pct", "a"), ("above_pct", "b"), ("vol_pct", "v"))), VW, GATE_SQL, WIN_SQL))
def window_separation(spark, sf):
    w = rg.window_comparison(weekly(spark, sf), 4, 52).withColumn("good", F.col("return_pct") > 0)
    s = rg.separates(w, ("advance_pct", "above_pct", "vol_pct"))
    return rounded(s.withColumn("clean", F.col("clean").cast("int")), "good_mean", "bad_mean")


BRK = f"""brk AS (SELECT *, {gate('max', 'high', 20, prior(20))} AS top, volume / nullif({gate('avg', 'volume', 20, prior(20))}, 0) AS vr FROM dense)"""


def confirmed(p, buffer=1.0, ratio=1.2):
    d = p.withColumns({"top": W.rolling_prior(F.max, "close", 20), "vr": F.col("volume") / F.nullif(W.rolling_prior(F.avg, "volume", 20), F.lit(0.0))})
    return d.withColumn("hit", truth((F.col("close") >= F.col("top") * (1 + buffer / 100)) & (F.col("vr") >= ratio)))


@query("2.5.66", sql(f"SELECT symbol, {day('session')}, {r('vr', 'vr')} FROM brk JOIN gt USING (session) WHERE close >= top * 1.01 AND vr >= 1.2 AND gate",
                     VW, GATE_SQL, BRK.replace("'high'", "'close'").replace("max(high)", "max(close)").replace("count(high)", "count(close)")))
def volume_breakouts(spark, sf):
    p = weekly(spark, sf)
    g = rg.index_gate(p).where("gate").select("session")
    return show(confirmed(p).where("hit").join(g, "session", "left_semi"), "vr")


@query("2.5.69", sql(f"""SELECT symbol, {r('quantile_cont(vr, 0.5)', 'median_ratio')}, {r('avg(CASE WHEN vr >= 1.2 THEN 1.0 ELSE 0 END)', 'over_12')}, {r('avg(CASE WHEN vr >= 2 THEN 1.0 ELSE 0 END)', 'over_20')}
      FROM brk WHERE vr IS NOT NULL GROUP BY symbol""", VW, BRK))
def volume_ratio_distribution(spark, sf):
    d = confirmed(weekly(spark, sf)).where("vr IS NOT NULL").groupBy("symbol").agg(
        F.percentile("vr", 0.5).alias("median_ratio"), F.avg((F.col("vr") >= 1.2).cast("double")).alias("over_12"),
        F.avg((F.col("vr") >= 2).cast("double")).alias("over_20"))
    return rounded(d, "median_ratio", "over_12", "over_20")


# ---- pairs ---------------------------------------------------------------

CAND = ["tv AS (SELECT symbol, sum(turnover) AS tv FROM bars0 GROUP BY symbol)",
        "rk AS (SELECT symbol, industry, row_number() OVER (PARTITION BY industry ORDER BY tv DESC, symbol) AS n FROM tv JOIN mk USING (symbol))",
        "cand AS (SELECT a.industry, a.symbol AS y, b.symbol AS x FROM rk a JOIN rk b ON a.industry = b.industry AND a.n < b.n WHERE a.n <= 4 AND b.n <= 4)",
        """jt AS (SELECT y, x, a.idx, a.session, a.close AS py, b.close AS px, row_number() OVER (PARTITION BY y, x ORDER BY a.idx) - 1 AS pos
             FROM cand JOIN bars a ON a.symbol = y JOIN bars b ON b.symbol = x AND b.idx = a.idx)"""]
PAIRS = [VW, MAKERS, CAND]


def joint(spark, sf):
    p = cut_lineage(weekly(spark, sf))
    tv = p.groupBy("symbol").agg(F.sum("turnover").alias("turnover"))
    return pr.aligned(p, pr.candidates(tv, makers(p), 4))


@query("2.3.9 2.10.2", sql("SELECT industry, y, x FROM cand", PAIRS))
def pair_candidates(spark, sf):
    p = weekly(spark, sf)
    return pr.candidates(p.groupBy("symbol").agg(F.sum("turnover").alias("turnover")), makers(p), 4)


@query("2.7.1", sql(f"SELECT y, x, count(*) AS n, {r('regr_slope(py, px)', 'beta')}, {r('regr_intercept(py, px)', 'alpha')} FROM jt GROUP BY y, x", PAIRS))
def hedge_ratios(spark, sf):
    return rounded(pr.hedge_ratio(joint(spark, sf)), "beta", "alpha")


WALK = ["""fit AS (SELECT y, x, pos AS p0, (SELECT regr_slope(py, px) FROM jt b WHERE b.y = a.y AND b.x = a.x AND b.pos BETWEEN a.pos - 100 AND a.pos - 1) AS beta,
          (SELECT regr_intercept(py, px) FROM jt b WHERE b.y = a.y AND b.x = a.x AND b.pos BETWEEN a.pos - 100 AND a.pos - 1) AS alpha FROM jt a WHERE pos >= 100 AND (pos - 100) % 21 = 0)""",
        "wj AS (SELECT jt.*, beta, alpha FROM jt JOIN fit ON fit.y = jt.y AND fit.x = jt.x AND p0 = pos - (pos - 100) % 21 WHERE pos >= 100)",
        """walk AS (SELECT w.y, w.x, w.session, w.pos, w.py, w.px, w.beta, w.py - w.beta * w.px - w.alpha AS spread,
             (w.py - w.beta * w.px - w.alpha - avg(b.py - w.beta * b.px - w.alpha)) / stddev_samp(b.py - w.beta * b.px - w.alpha) AS z
           FROM wj w JOIN jt b ON b.y = w.y AND b.x = w.x AND b.pos BETWEEN w.pos - 100 AND w.pos - 1 GROUP BY w.y, w.x, w.session, w.pos, w.py, w.px, w.beta, w.alpha)"""]


@query("2.5.64", sql(f"SELECT y, x, {day('session')}, {r('beta', 'beta')}, {r('spread', 'spread')}, {r('z', 'zscore')} FROM walk", PAIRS, WALK))
def walked_spread(spark, sf):
    return show(pr.walk_spread(joint(spark, sf), 100), "beta", "spread", "zscore", keep=("y", "x", "session"))


STATE = ["tl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY pos DESC) AS k FROM jt) WHERE k <= 250)",
         "ft0 AS (SELECT y, x, count(*) AS n, regr_slope(py, px) AS b, regr_intercept(py, px) AS a FROM tl GROUP BY y, x)",
         "sp AS (SELECT y, x, pos, n, a, b, s, lag(s) OVER (PARTITION BY y, x ORDER BY pos) AS ls FROM (SELECT tl.y, tl.x, pos, n, a, b, py - b * px - a AS s FROM tl JOIN ft0 USING (y, x)))",
         """ps AS (SELECT y, x, max(n) AS n_obs, max(b) AS beta, max(a) AS alpha, arg_max(s, pos) AS spread, (arg_max(s, pos) - avg(s)) / stddev_samp(s) AS z,
              CASE WHEN regr_slope(s - ls, ls) < 0 THEN -ln(2) / regr_slope(s - ls, ls) END AS hl FROM sp GROUP BY y, x)"""]


@query("2.7.2", sql(f"SELECT y, x, n_obs, {r('beta', 'beta')}, {r('alpha', 'alpha')}, {r('spread', 'spread')}, {r('z', 'zscore')}, {r('hl', 'half_life')} FROM ps", PAIRS, STATE))
def pair_states(spark, sf):
    return rounded(pr.pair_state(joint(spark, sf)).drop("pvalue"), "beta", "alpha", "spread", "zscore", "half_life")


@query("2.7.3 2.7.14 2.10.5")
def pair_screen(spark, sf):
    s = pr.screen(cut_lineage(pr.pair_state(joint(spark, sf))))
    return rounded(s, "beta", "zscore", "half_life", "pvalue", "qvalue").orderBy(F.asc_nulls_last("pvalue"))


# p-values derived from the tables, to check the false-discovery arithmetic itself
FDR_SRC = """pv AS (SELECT 'S' || l_suppkey AS y, 'P' || (l_suppkey % 7) AS x, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE (avg(l_discount) * 8 - 0.36) ** 2 * 5 END AS pvalue,
     1.0 AS beta, avg(l_tax) * 500 AS half_life FROM lineitem GROUP BY l_suppkey)"""


@query("2.7.3", sql(f"""SELECT y, {r('pvalue', 'pvalue')}, {r('q', 'qvalue')}, reason, CAST(reason = '' AND coalesce(k <= (SELECT max(k) FROM fq WHERE pvalue <= k / m * 0.4), false) AS INTEGER) AS passes
      FROM (SELECT pv.y, pv.pvalue, k, q, CASE WHEN pv.pvalue IS NULL THEN 'no p-value' WHEN half_life < 18 THEN 'half-life too short to pay for its trades' WHEN half_life > 22 THEN 'half-life longer than a position is held' ELSE '' END AS reason
            FROM pv LEFT JOIN fq USING (y))""", FDR_SRC,
      "f0 AS (SELECT y, pvalue, row_number() OVER (ORDER BY pvalue, y) AS k, CAST(count(*) OVER () AS DOUBLE) AS m FROM pv WHERE pvalue IS NOT NULL)",
      "fq AS (SELECT *, least(1.0, min(pvalue * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM f0)"))
def false_discovery(spark, sf):
    li = t.table(spark, sf, "lineitem")
    k = F.col("l_suppkey")
    pv = li.groupBy("l_suppkey").agg(F.pow(F.avg("l_discount") * 8 - 0.36, F.lit(2.0)).alias("p"), (F.avg("l_tax") * 500).alias("half_life"))
    pv = pv.select(F.concat(F.lit("S"), "l_suppkey").alias("y"), F.concat(F.lit("P"), k % 7).alias("x"),
                   F.when(k % 9 != 0, F.col("p") * 5).alias("pvalue"), F.lit(1.0).alias("beta"), "half_life")
    s = pr.screen(pv, 0.4, 18.0, 22.0)
    return rounded(s.select("y", "pvalue", "qvalue", "reason", F.col("passes").cast("int").alias("passes")), "pvalue", "qvalue")


PNL = """tr AS (WITH RECURSIVE o AS (SELECT y, x, pos, z, py, px, beta, row_number() OVER (PARTITION BY y, x ORDER BY pos) AS rn FROM SRC),
    f AS (SELECT y, x, CAST(0 AS BIGINT) AS rn, 0 AS side, CAST(0 AS DOUBLE) AS ey, CAST(0 AS DOUBLE) AS ex, CAST(0 AS DOUBLE) AS eb, CAST(0 AS DOUBLE) AS tot, 0 AS n FROM (SELECT DISTINCT y, x FROM o)
      UNION ALL SELECT f.y, f.x, o.rn, CASE WHEN side = 0 AND abs(z) >= 2 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END WHEN side <> 0 AND abs(z) <= 0.5 THEN 0 ELSE side END,
        CASE WHEN side = 0 AND abs(z) >= 2 THEN py ELSE ey END, CASE WHEN side = 0 AND abs(z) >= 2 THEN px ELSE ex END, CASE WHEN side = 0 AND abs(z) >= 2 THEN beta ELSE eb END,
        CASE WHEN side <> 0 AND abs(z) <= 0.5 THEN tot + 100 * side * ((py - ey) - eb * (px - ex)) / (abs(ey) + abs(eb * ex)) - 0.5 ELSE tot END,
        CASE WHEN side <> 0 AND abs(z) <= 0.5 THEN n + 1 ELSE n END
      FROM f JOIN o ON o.y = f.y AND o.x = f.x AND o.rn = f.rn + 1)
    SELECT y, x, arg_max(n, rn) AS n, arg_max(tot, rn) AS tot FROM f GROUP BY y, x)"""
INS = ["ib AS (SELECT y, x, regr_slope(py, px) AS b, regr_intercept(py, px) AS a FROM jt GROUP BY y, x)",
       "isx AS (SELECT y, x, pos, py, px, b AS beta, py - b * px - a AS s FROM jt JOIN ib USING (y, x))",
       "ins AS (SELECT *, (s - avg(s) OVER p) / stddev_samp(s) OVER p AS z FROM isx WINDOW p AS (PARTITION BY y, x))"]


@query("2.6.26 2.6.37", sql(f"""SELECT a.y, a.x, a.n AS trips_walked, {r('a.tot', 'walked_pct')}, b.n AS trips_in_sample, {r('b.tot', 'in_sample_pct')}, {r('b.tot - a.tot', 'difference')}
      FROM tr a JOIN tr2 b USING (y, x)""", PAIRS, WALK, PNL.replace("SRC", "walk"), INS, PNL.replace("SRC", "ins").replace("tr AS", "tr2 AS", 1)))
def spread_pnl(spark, sf):
    j = joint(spark, sf)
    a = pr.spread_pnl(pr.walk_spread(j, 100)).select("y", "x", F.col("round_trips").alias("trips_walked"), F.col("total_pct").alias("walked_pct"))
    b = pr.spread_pnl(pr.in_sample(j)).select("y", "x", F.col("round_trips").alias("trips_in_sample"), F.col("total_pct").alias("in_sample_pct"))
    d = a.join(b, ["y", "x"]).withColumn("difference", F.col("in_sample_pct") - F.col("walked_pct"))
    return rounded(d, "walked_pct", "in_sample_pct", "difference")


# ---- per-symbol statistics -----------------------------------------------

HURST = ["lx AS (SELECT symbol, ln(close) AS lx, row_number() OVER (PARTITION BY symbol ORDER BY session) AS p FROM bars0)",
         "cnt AS (SELECT symbol, count(*) AS n, greatest(4, least(count(*) // 4, 100)) AS cap FROM lx GROUP BY symbol)",
         "tau AS (SELECT a.symbol, g AS lag, stddev_pop(a.lx - b.lx) AS tau FROM lx a JOIN cnt USING (symbol) JOIN range(2, 101) r(g) ON g <= cap JOIN lx b ON b.symbol = a.symbol AND b.p = a.p - g GROUP BY ALL)",
         "hu AS (SELECT symbol, n, count(*) AS usable, regr_slope(ln(tau), ln(lag)) AS h FROM tau JOIN cnt USING (symbol) WHERE tau > 0 AND n >= 120 GROUP BY symbol, n)"]


@query("2.7.4", sql(f"SELECT symbol, n AS n_obs, usable AS usable_lags, {r('h', 'h')} FROM hu", VW, HURST))
def hurst_exponents(spark, sf):
    h = ss.hurst(weekly(spark, sf))
    return rounded(h.withColumn("usable_lags", F.col("usable_lags").cast("long")), "h")


NULLS = "nul AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {list(v)})" for k, v in ss.HURST_NULL.items()) + ") v(size, q))"
PV = [NULLS, "bl AS (SELECT hu.*, (SELECT arg_max(q, size) FROM nul WHERE size <= n) AS a, (SELECT arg_min(q, size) FROM nul WHERE size >= n) AS b, (SELECT max(size) FROM nul WHERE size <= n) AS lo, (SELECT min(size) FROM nul WHERE size >= n) AS hi FROM hu)",
      "bx AS (SELECT symbol, n, h, list_transform(range(1, 14), lambda i: a[i] + CASE WHEN lo = hi THEN 0 ELSE (ln(n) - ln(lo)) / (ln(hi) - ln(lo)) END * (b[i] - a[i])) AS q FROM bl)",
      "lv AS (SELECT " + str(list(ss.NULL_LEVELS)) + " AS l)",
      """hp AS (SELECT symbol, n, h, q[1] AS mean, q[2] AS sd, CASE WHEN h <= q[3] THEN 0.001 WHEN h >= q[13] THEN 0.99 ELSE
           (SELECT l[i] + (h - q[i + 2]) / (q[i + 3] - q[i + 2]) * (l[i + 1] - l[i]) FROM range(1, 11) g(i) WHERE h > q[i + 2] AND h <= q[i + 3]) END AS p FROM bx, lv)"""]


@query("2.7.5", sql(f"SELECT symbol, {r('h', 'h')}, {r('mean', 'null_mean')}, {r('sd', 'null_sd')}, {r('p', 'pvalue')} FROM hp", VW, HURST, PV))
def hurst_pvalues(spark, sf):
    h = ss.hurst_pvalue(ss.hurst(weekly(spark, sf)))
    return rounded(h, "h", "null_mean", "null_sd", "pvalue").drop("n_obs", "usable_lags")


@query("2.7.13 2.4.23", sql(f"""SELECT count(h) AS estimable, (SELECT count(DISTINCT symbol) FROM bars0) - count(h) AS refused, count(*) FILTER (p <= 0.05) AS passed, count(*) FILTER (h < 0.45) AS fixed_threshold,
      {r('0.05 * count(h)', 'expected')}, {r('(count(*) FILTER (p <= 0.05) - 0.05 * count(h)) / sqrt(count(h) * 0.05 * 0.95)', 'z')},
      CAST(abs((count(*) FILTER (p <= 0.05) - 0.05 * count(h)) / sqrt(count(h) * 0.05 * 0.95)) > 2 AS INTEGER) AS significant FROM hp""", VW, HURST, PV))
def mean_reversion_screen(spark, sf):
    s = ss.mean_reversion_screen(ss.hurst_pvalue(ss.hurst(weekly(spark, sf))))
    return rounded(s.withColumn("significant", F.col("significant").cast("int")), "expected", "z")


ACF = [f"rr AS (SELECT symbol, p, r, abs(r) AS a FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY session) AS p, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS r FROM bars0) WHERE r IS NOT NULL)",
       "dm AS (SELECT symbol, p, r - avg(r) OVER s AS r, a - avg(a) OVER s AS a FROM rr WINDOW s AS (PARTITION BY symbol))",
       "den AS (SELECT symbol, count(*) AS n, sum(r * r) AS vr, sum(a * a) AS va FROM dm GROUP BY symbol)",
       "ac AS (SELECT x.symbol, k, sum(x.r * y.r) / any_value(vr) AS ar, sum(x.a * y.a) / any_value(va) AS aa, any_value(n) AS n FROM dm x JOIN range(1, 31) g(k) ON true JOIN dm y ON y.symbol = x.symbol AND y.p = x.p - k JOIN den ON den.symbol = x.symbol GROUP BY x.symbol, k)"]


@query("2.7.7", sql(f"""SELECT symbol, any_value(n) AS n_obs, {r('max(ar) FILTER (k = 1)', 'acf1')}, {r('max(aa) FILTER (k = 5)', 'abs_acf5')},
      {r('any_value(n) * (any_value(n) + 2) * sum(ar * ar / (n - k)) FILTER (k <= 10)', 'q_ret_10')}, {r('any_value(n) * (any_value(n) + 2) * sum(aa * aa / (n - k)) FILTER (k <= 20)', 'q_abs_20')},
      {r('exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24)', 'p_ret_10')}, {r('avg(abs(aa)) FILTER (k <= 5) / avg(abs(ar)) FILTER (k <= 5)', 'ratio')}
      FROM ac JOIN (SELECT symbol, any_value(n) * (any_value(n) + 2) * sum(ar * ar / (n - k)) AS q FROM ac WHERE k <= 10 GROUP BY symbol) USING (symbol) GROUP BY symbol, q""", VW, ACF))
def persistence(spark, sf):
    p = ss.persistence(weekly(spark, sf))
    out = p.select("symbol", "n_obs", F.get("acf_ret", F.lit(0)).alias("acf1"), F.get("acf_abs", F.lit(4)).alias("abs_acf5"),
                   "q_ret_10", "q_abs_20", "p_ret_10", "ratio")
    return rounded(out, "acf1", "abs_acf5", "q_ret_10", "q_abs_20", "p_ret_10", "ratio")


@query("2.7.6")
def unit_root_tests(spark, sf):
    return rounded(ss.unit_roots(weekly(spark, sf)), "adf", "adf_p", "kpss", "kpss_p")


@query("2.7.10 2.7.15")
def volatility_states(spark, sf):
    s = ss.state_summary(ss.volatility_states(weekly(spark, sf)), 300)
    return rounded(s, *[c for c, ty in s.dtypes if ty == "double"])


SR = f"SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY session) - 1 AS r FROM bars0"


def weekly_returns(spark, sf):
    w = Window.partitionBy("symbol").orderBy("idx")
    return weekly(spark, sf).withColumn("r", F.col("close") / F.lag("close").over(w) - 1.0).where("r IS NOT NULL")


@query("2.7.11", sql(f"""SELECT symbol, count(r) AS n, {r('avg(r) / stddev_samp(r)', 'sharpe')}, {r('avg(r) / stddev_samp(r) * sqrt(52)', 'annual_sharpe')},
      {r('sum((r - m) ** 3) / count(r) / (stddev_pop(r) ** 3)', 'skew')}, {r('sum((r - m) ** 4) / count(r) / (stddev_pop(r) ** 4) - 3', 'excess_kurtosis')}
      FROM (SELECT *, avg(r) OVER (PARTITION BY symbol) AS m FROM ({SR}) WHERE r IS NOT NULL) GROUP BY symbol""", VW))
def sharpe_moments(spark, sf):
    s = ss.sharpe_robustness(weekly_returns(spark, sf), ["symbol"], "r", periods=52)
    return rounded(s.select("symbol", "n", "sharpe", "annual_sharpe", "skew", "excess_kurtosis"), "sharpe", "annual_sharpe", "skew", "excess_kurtosis")


@query("2.7.11")
def sharpe_deflated(spark, sf):
    s = ss.sharpe_robustness(weekly_returns(spark, sf), ["symbol"], "r", trials=20, periods=52)
    return rounded(s, *[c for c, ty in s.dtypes if ty == "double"])


@query("2.7.12", f"""SELECT symbol, k, n, {r('CASE WHEN k <= 0 THEN 1.0 ELSE list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.2) + (n - i) * ln(0.8)))) END', 'tail')}
      FROM (SELECT 'S' || l_suppkey AS symbol, count(*) FILTER (l_discount >= 0.08) AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey)""")
def binomial_tails(spark, sf):
    li = t.table(spark, sf, "lineitem")
    g = li.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("symbol")).agg(F.count_if(F.col("l_discount") >= 0.08).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("tail", r6(ss.binomial_tail("k", "n", 0.2)))


# ---- clusters ------------------------------------------------------------

def labelled(spark, sf, threshold, delta=0.0):
    return cl.clusters(cut_lineage(weekly(spark, sf)), lookback=150, threshold=threshold, completeness=0.9, min_overlap=60, delta=delta)


@query("2.7.8 2.7.16")
def correlation_clusters(spark, sf):
    """A label, or the reason why there is none, of every name."""
    lab = cut_lineage(labelled(spark, sf, 0.12))
    return lab.join(cl.sizes(lab), "label", "left")


@query("2.7.8", sql("""SELECT symbol, CASE WHEN NOT enough THEN 'too few prices in the window' END AS reason, n_obs FROM
      (SELECT symbol, count(ret) >= greatest(round(0.9 * (max(hi) - min(lo))), 3) AS enough FROM wr GROUP BY symbol),
      (SELECT count(*) AS n_obs FROM (SELECT idx, count(ret) AS k FROM wr JOIN (SELECT symbol FROM wr GROUP BY symbol HAVING count(ret) >= greatest(round(0.9 * (max(hi) - min(lo))), 3)) USING (symbol)
       GROUP BY idx) WHERE k = (SELECT count(*) FROM (SELECT symbol FROM wr GROUP BY symbol HAVING count(ret) >= greatest(round(0.9 * (max(hi) - min(lo))), 3))))""", VW,
      """wn AS (SELECT symbol, idx, close, max(idx) OVER () AS hi, min(idx) OVER () AS lo FROM bars WHERE idx > (SELECT max(idx) - 150 FROM bars))""",
      """wr AS (SELECT a.*, a.close / nullif(b.close, 0) - 1 AS ret FROM wn a LEFT JOIN wn b ON a.symbol = b.symbol AND b.idx = a.idx - 1)"""))
def cluster_coverage(spark, sf):
    """Which names can be clustered at all, and over how many common sessions."""
    return cl.measured_names(cut_lineage(weekly(spark, sf)), lookback=150, completeness=0.9, min_overlap=1).select("symbol", "reason", "n_obs")


@query("2.7.9")
def cluster_shrinkage(spark, sf):
    """How the clusters change when correlations are shrunk: their number, the largest, agreement with the unshrunk ones."""
    plain = cut_lineage(labelled(spark, sf, 0.12).where("label IS NOT NULL"))
    out = None
    for delta in (0.0, 0.1, 0.3, 0.5):
        other = plain if delta == 0.0 else cut_lineage(labelled(spark, sf, 0.12, delta).where("label IS NOT NULL"))
        size = other.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"))
        row = size.crossJoin(cl.adjusted_rand(plain, other)).withColumn("delta", F.lit(delta))  # one row each
        out = row if out is None else out.unionByName(row)
    return rounded(out, "ari")


@query("2.7.9", sql(f"""SELECT {r('(ij - i * j / t) / nullif((i + j) / 2 - i * j / t, 0)', 'ari')} FROM
      (SELECT sum(n * (n - 1) / 2) AS ij FROM (SELECT count(*) AS n FROM lb GROUP BY la, lb)), (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT count(*) AS n FROM lb GROUP BY la)),
      (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT count(*) AS n FROM lb GROUP BY lb)), (SELECT count(*) * (count(*) - 1) / 2 AS t FROM lb)""",
      "lb AS (SELECT c_custkey, c_nationkey AS la, c_mktsegment || (c_nationkey // 5) AS lb FROM customer)"))
def adjusted_rand(spark, sf):
    c = t.table(spark, sf, "customer")
    a = c.select(F.col("c_custkey").alias("symbol"), F.col("c_nationkey").alias("label"))
    b = c.select(F.col("c_custkey").alias("symbol"), F.concat("c_mktsegment", F.floor(F.col("c_nationkey") / 5)).alias("label"))
    return rounded(cl.adjusted_rand(a, b), "ari")


@query("2.7.17", sql(f"""SELECT {r('avg(CASE WHEN dup THEN 1.0 ELSE 0 END)', 'collision_share')}, count(*) AS days FROM (SELECT session, count(*) > count(DISTINCT industry) AS dup FROM
      (SELECT session, symbol, industry, row_number() OVER (PARTITION BY session ORDER BY turnover DESC, symbol) AS n FROM bars JOIN mk USING (symbol) WHERE idx > (SELECT max(idx) - 60 FROM cal)) WHERE n <= 4 GROUP BY session)""", VW, MAKERS))
def shortlist_collisions(spark, sf):
    p = cut_lineage(weekly(spark, sf))
    w = Window.partitionBy("session").orderBy(F.desc("turnover"), "symbol")
    top = p.where(F.col("idx") > p.agg(F.max("idx") - 60).scalar()).withColumn("n", F.row_number().over(w)).where("n <= 4")
    d = top.join(makers(p), "symbol").groupBy("session").agg((F.count(F.lit(1)) > F.count_distinct("industry")).alias("dup"))
    return d.agg(r6(F.avg(F.col("dup").cast("double")), "collision_share"), F.count(F.lit(1)).alias("days"))


@query("2.7.17")
def cluster_collisions(spark, sf):
    """Sessions on which two of the four most traded names belong to one cluster."""
    p = cut_lineage(weekly(spark, sf))
    w = Window.partitionBy("session").orderBy(F.desc("turnover"), "symbol")
    top = p.where(F.col("idx") > p.agg(F.max("idx") - 60).scalar()).withColumn("n", F.row_number().over(w)).where("n <= 4")
    return dated(cl.collisions(top, labelled(spark, sf, 0.12)), "session")


SWEEP = [dict(stop_pct=float(s), rr=2.0, hold=h) for s in (4, 8, 12, 16, 20) for h in (6, 12)]


@query("2.6.35 2.6.36", None)
def stop_width_sweep(spark, sf):
    """Stops by holds by windows from one walk, with the share of windows positive."""
    p = cut_lineage(weekly(spark, sf).withColumn("open", F.col("close")))
    sig = confirmed(p, 0.0, 1.0).where("hit").select("symbol", "idx")
    size = p.agg(F.max("idx") + 1).scalar()
    lat = oc.lattice(p, SWEEP).join(sig, ["symbol", "idx"]).withColumn("window", F.floor(F.col("idx") * 4 / size))
    kept = oc.sequential(lat.select("symbol", "stop_pct", "hold", "window", "idx", "exit_at", "r"), ["symbol", "stop_pct", "hold", "window"])
    per = kept.groupBy("stop_pct", "hold", "window").agg(F.count(F.lit(1)).alias("trades"), (F.avg("r") - 0.4222 / F.first("stop_pct")).alias("net_r"))
    return rounded(per.groupBy("stop_pct", "hold").agg(F.sum("trades").alias("trades"), F.avg("net_r").alias("net_r"),
                                                       F.avg((F.col("net_r") > 0).cast("double")).alias("positive_share")), "net_r", "positive_share")
