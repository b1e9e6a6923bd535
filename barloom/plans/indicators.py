"""Indicator queries over whole panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames as W
from ..functions.ewm import ewm, wilder_alpha
from ..functions.scalars import ratio, truth
from ..operators import indicators as ind, presets, states
from ..operators.panel import densify
from . import tables as t
from .oracle import HOURS, brand, day, ewm as sql_ewm, panel as P, r, sql
from .registry import query
from .scans import dated, rounded

BW = P("week", brand)  # 25 symbols, long and almost full
SM = P("month")        # many symbols, some gaps


def show(df, *cols, keep=("symbol", "session")):
    out = rounded(df.select(*keep, *cols), *[c for c, ty in df.select(*cols).dtypes if ty == "double"])
    return dated(out, "session")


def rows(n: int, start: str = "0") -> str:
    """Frame of the last n rows of the dense matrix."""
    return f"OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


LAG = "OVER (PARTITION BY symbol ORDER BY idx)"


def gate(agg: str, x: str, n: int, over=None, need=None) -> str:
    o = over or rows(n)
    return f"CASE WHEN count({x}) {o} >= {need or n} THEN {agg}({x}) {o} END"


def body(cols: str, src: str = "q") -> str:
    return f"SELECT symbol, {day('session')}, {cols} FROM {src} WHERE close IS NOT NULL"


def layer(name: str, cols: str, src: str = "dense") -> str:
    return f"{name} AS (SELECT *, {cols} FROM {src})"


def rs(*names) -> str:
    return ", ".join(r(n, n) for n in names)


@query("2.5.1 2.5.2 2.5.3", sql(body(rs("sma_5", "sma_20", "ema_12", "wilder_14")), SM,
       sql_ewm("dense", "e", ema_12=("close", "2.0/13"), wilder_14=("close", "1.0/14")),
       f"""q AS (SELECT d.*, {gate('avg', 'close', 5)} AS sma_5, {gate('avg', 'close', 20)} AS sma_20,
           e.ema_12, e.wilder_14 FROM dense d JOIN e USING (symbol, idx))"""))
def ind_moving_averages(spark, sf):
    b = ewm(t.bars(spark, sf), {"ema_12": ("close", 2 / 13), "wilder_14": ("close", wilder_alpha(14))})
    b = b.withColumns({"sma_5": W.sma("close", 5), "sma_20": W.sma("close", 20)})
    return show(b, "sma_5", "sma_20", "ema_12", "wilder_14")


MACD_SQL = [sql_ewm("dense", "e1", f=("close", "2.0/13"), s=("close", "2.0/27")),
            "m AS (SELECT symbol, idx, f - s AS macd FROM e1)",
            sql_ewm("m", "e2", sig=("macd", "2.0/10")),
            """q AS (SELECT d.*, macd, sig AS macd_signal, macd - sig AS macd_hist
                FROM dense d JOIN m USING (symbol, idx) JOIN e2 USING (symbol, idx))"""]


@query("2.5.4 2.5.2", sql(body(rs("macd", "macd_signal", "macd_hist")), SM, MACD_SQL))
def ind_macd(spark, sf):
    return show(ind.macd(t.bars(spark, sf)), "macd", "macd_signal", "macd_hist")


@query("2.5.5", sql(f"""SELECT symbol, {day('session')}, strftime(bar_ts, '%H:%M') AS bar, {r('vwap', 'vwap')}
    FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap
          FROM hours WINDOW w AS (PARTITION BY symbol, session ORDER BY bar_ts))""", HOURS))
def ind_session_vwap(spark, sf):
    h = t.hour_bars(spark, sf).withColumn("vwap", ind.session_vwap())
    h = h.withColumn("bar", F.date_format("bar_ts", "HH:mm"))
    return show(h, "vwap", keep=("symbol", "session", "bar"))


@query("2.5.6 2.5.7", sql(body(rs("vwap", "rel_volume")), SM, layer("q",
    f"""{gate('sum', '((high + low + close) / 3 * volume)', 20)} / nullif({gate('sum', 'volume', 20)}, 0) AS vwap,
        volume / nullif({gate('avg', 'volume', 20, prior(20))}, 0) AS rel_volume""")))
def ind_rolling_vwap(spark, sf):
    b = t.bars(spark, sf).withColumns({"vwap": ind.rolling_vwap(20), "rel_volume": ind.relative_volume(20)})
    return show(b, "vwap", "rel_volume")


TR = f"greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) AS tr"


@query("2.5.8 2.5.9 2.5.10 2.5.20", sql(body(rs("true_range", "atr", "atr_sma", "atr_pct")), SM, layer("x", TR),
       sql_ewm("x", "e", atr=("tr", "1.0/14")),
       f"""q AS (SELECT x.*, tr AS true_range, atr, {gate('avg', 'tr', 14)} AS atr_sma, 100 * atr / close AS atr_pct
           FROM x JOIN e USING (symbol, idx))"""))
def ind_atr(spark, sf):
    b = ind.atr(t.bars(spark, sf))
    b = b.withColumns({"atr_sma": W.sma("true_range", 14), "atr_pct": 100 * ratio("atr", "close")})
    return show(b, "true_range", "atr", "atr_sma", "atr_pct")


BB = f"""{gate('avg', 'close', 20)} AS mid, {gate('stddev_samp', 'close', 20)} AS sd,
         {gate('stddev_pop', 'close', 20)} AS sdp"""


@query("2.5.11 2.5.12 2.5.39", sql(body(", ".join([r("mid + 2 * sd", "bb_upper"), r("mid", "bb_mid"),
       r("mid - 2 * sd", "bb_lower"), r("100 * 4 * sd / mid", "bb_width_pct"),
       r("mid + 2 * sdp", "pop_upper"), r("mid - 2 * sdp", "pop_lower")])), SM, layer("q", BB)))
def ind_bollinger(spark, sf):
    pop = ind.bollinger(sample=False)
    b = t.bars(spark, sf).withColumns({**ind.bollinger(), "pop_upper": pop["bb_upper"],
                                       "pop_lower": pop["bb_lower"]})
    return show(b, "bb_upper", "bb_mid", "bb_lower", "bb_width_pct", "pop_upper", "pop_lower")


@query("2.5.13 2.5.52", sql(body(f"{r('w', 'bb_width_pct')}, CAST(coalesce(w <= edge, false) AS INTEGER) AS compressed"),
       BW, layer("x", BB), layer("y", "100 * 4 * sd / mid AS w", "x"),
       layer("q", f"CASE WHEN count(w) {rows(60)} >= 40 THEN quantile_cont(w, 0.2) {rows(60)} END AS edge", "y")))
def ind_compressed(spark, sf):
    b = t.brand_bars(spark, sf, "week").withColumn("bb_width_pct", ind.bollinger()["bb_width_pct"])
    b = ind.compressed(b, n=60, need=40)
    return show(b.withColumn("compressed", F.col("compressed").cast("int")), "bb_width_pct", "compressed")


@query("2.5.14 2.5.15", sql(body(f"""{r('g', 'gap_pct')}, CASE WHEN g >= 2 THEN 'up' WHEN g <= -2 THEN 'down'
       ELSE 'none' END AS gap_class"""), SM, layer("q", f"100 * (open / lag(close) {LAG} - 1) AS g")))
def ind_gap(spark, sf):
    b = t.bars(spark, sf).withColumn("gap_pct", ind.gap_pct())
    return show(b.withColumn("gap_class", ind.gap_class(F.col("gap_pct"))), "gap_pct", "gap_class")


CENTRE = "OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
SWING = [layer("x0", f"list(high) {CENTRE} AS hs, list(low) {CENTRE} AS ls"),
         layer("x", """coalesce(len(list_filter(hs, lambda v: v IS NOT NULL)) = 7 AND high = list_max(hs)
              AND len(list_filter(hs, lambda v: v = high)) = 1, false) AS sh,
           coalesce(len(list_filter(ls, lambda v: v IS NOT NULL)) = 7 AND low = list_min(ls)
              AND len(list_filter(ls, lambda v: v = low)) = 1, false) AS sl""", "x0")]


@query("2.5.16", sql(body("CAST(sh AS INTEGER) AS swing_high, CAST(sl AS INTEGER) AS swing_low", "x"), SM, SWING))
def ind_swing_points(spark, sf):
    b = t.bars(spark, sf).withColumns({k: v.cast("int") for k, v in ind.swing_points(3).items()})
    return show(b, "swing_high", "swing_low")


STRUCT = ["""piv AS (SELECT symbol, session, idx, 'high' AS kind, high AS level FROM x WHERE sh
            UNION ALL SELECT symbol, session, idx, 'low', low FROM x WHERE sl)""",
          """lab AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN kind = 'high' THEN
                CASE WHEN level > p THEN 'HH' ELSE 'LH' END ELSE CASE WHEN level > p THEN 'HL' ELSE 'LL' END END AS label
             FROM (SELECT *, lag(level) OVER (PARTITION BY symbol, kind ORDER BY idx) AS p FROM piv))"""]


@query("2.5.17", sql(f"SELECT symbol, {day('session')}, kind, {r('level', 'level')}, label FROM lab", SM, SWING, STRUCT))
def ind_market_structure(spark, sf):
    return show(ind.market_structure(t.bars(spark, sf)), "kind", "level", "label")


@query("2.5.18", sql("""SELECT symbol, h AS last_high, l AS last_low, CASE WHEN h = 'HH' AND l = 'HL' THEN 'uptrend'
      WHEN h = 'LH' AND l = 'LL' THEN 'downtrend' WHEN h IS NOT NULL AND l IS NOT NULL THEN 'mixed'
      ELSE 'unknown' END AS bias FROM (SELECT symbol,
        arg_max(label, idx) FILTER (kind = 'high') AS h, arg_max(label, idx) FILTER (kind = 'low') AS l
      FROM lab WHERE label IS NOT NULL GROUP BY symbol)""", SM, SWING, STRUCT))
def ind_structure_bias(spark, sf):
    return ind.structure_bias(ind.market_structure(t.bars(spark, sf)))


DM = f"high - lag(high) {LAG} AS up, lag(low) {LAG} - low AS dn, {TR}"


def adx_sql(null_first: bool) -> list[str]:
    none = "NULL" if null_first else "CASE WHEN close IS NULL THEN NULL ELSE 0.0 END"
    return [layer("x0", DM),
            layer("x", f"""CASE WHEN up IS NULL OR dn IS NULL THEN {none} WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS pdm,
              CASE WHEN up IS NULL OR dn IS NULL THEN {none} WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS mdm""", "x0"),
            sql_ewm("x", "e", a=("tr", "1.0/14"), p=("pdm", "1.0/14"), m=("mdm", "1.0/14")),
            """y AS (SELECT x.*, 100 * p / CASE WHEN a > 0 THEN a END AS plus_di,
                 100 * m / CASE WHEN a > 0 THEN a END AS minus_di FROM x JOIN e USING (symbol, idx))""",
            """z AS (SELECT *, CASE WHEN plus_di + minus_di > 0 THEN
                 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END AS dx FROM y)""",
            sql_ewm("z", "e2", adx=("dx", "1.0/14")),
            "q AS (SELECT z.*, adx FROM z JOIN e2 USING (symbol, idx))"]


@query("2.5.19 2.5.21 2.5.46", sql(body(rs("pdm", "mdm", "plus_di", "minus_di", "adx")),
       BW, adx_sql(True)))
def ind_adx(spark, sf):
    b = ind.adx(t.brand_bars(spark, sf, "week")).withColumnsRenamed({"plus_dm": "pdm", "minus_dm": "mdm"})
    return show(b, "pdm", "mdm", "plus_di", "minus_di", "adx")


@query("2.5.67", sql(body(rs("plus_di", "minus_di", "adx")), BW, adx_sql(False)))
def ind_adx_library(spark, sf):
    return show(ind.adx(t.brand_bars(spark, sf, "week"), first_zero=True), "plus_di", "minus_di", "adx")


BENCH = "bench AS (SELECT session, avg(close) AS bench FROM bars0 GROUP BY session HAVING count(*) >= 25)"


@query("2.5.22 2.5.23 2.3.11", sql(body(rs("rs", "rs_rank")), BW, BENCH,
       "x AS (SELECT d.*, close / bench AS rs FROM dense d LEFT JOIN bench USING (session))",
       """q AS (SELECT a.*, CASE WHEN (SELECT count(rs) FROM x b WHERE b.symbol = a.symbol AND b.idx BETWEEN a.idx - 62 AND a.idx) = 63
            AND rs IS NOT NULL THEN 100.0 * (SELECT count(*) FROM x b WHERE b.symbol = a.symbol
              AND b.idx BETWEEN a.idx - 62 AND a.idx AND b.rs <= a.rs) / 63 END AS rs_rank FROM x a
          WHERE session IN (SELECT session FROM bench))"""))
def ind_relative_strength(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    bench = b.groupBy("session").agg(F.avg("close").alias("bench"), F.count(F.lit(1)).alias("n")).where("n >= 25").drop("n")
    b = ind.with_benchmark(b, bench).withColumn("rs", ind.rs_line())
    return show(ind.rs_rank(b, 63), "rs", "rs_rank")


@query("2.3.12", sql(body(rs("rs")), BW, BENCH,
       """carried AS (SELECT session, last_value(bench IGNORE NULLS) OVER (ORDER BY session) AS bench
            FROM (SELECT DISTINCT session FROM bars0) LEFT JOIN bench USING (session))""",
       "q AS (SELECT d.*, close / bench AS rs FROM dense d LEFT JOIN carried USING (session))"))
def ind_benchmark_filled(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    bench = b.groupBy("session").agg(F.avg("close").alias("bench"), F.count(F.lit(1)).alias("n")).where("n >= 25").drop("n")
    return show(ind.with_benchmark(b, bench, fill=True).withColumn("rs", ind.rs_line()), "rs")


HH = lambda n: gate("max", "high", n)
LL = lambda n: gate("min", "low", n)


@query("2.5.24 2.5.25", sql(body(rs("stoch_k", "stoch_d", "williams_r")), SM,
       layer("x", f"""100 * (close - {LL(14)}) / nullif({HH(14)} - {LL(14)}, 0) AS stoch_k,
            -100 * ({HH(14)} - close) / nullif({HH(14)} - {LL(14)}, 0) AS williams_r"""),
       layer("q", f"{gate('avg', 'stoch_k', 3)} AS stoch_d", "x")))
def ind_stochastic(spark, sf):
    b = t.bars(spark, sf).withColumns({"stoch_k": ind.stochastic_k(), "williams_r": ind.williams_r()})
    return show(b.withColumn("stoch_d", W.sma("stoch_k", 3)), "stoch_k", "stoch_d", "williams_r")


@query("2.5.26 2.13.1", sql(body(rs("aroon_up", "aroon_down")), SM,
       layer("x", f"list(high) {rows(25)} AS hs, list(low) {rows(25)} AS ls"),
       layer("q", """CASE WHEN len(list_filter(hs, lambda v: v IS NOT NULL)) = 25 THEN 100.0 * (list_position(hs, list_max(hs)) - 1) / 24 END AS aroon_up,
         CASE WHEN len(list_filter(ls, lambda v: v IS NOT NULL)) = 25 THEN 100.0 * (list_position(ls, list_min(ls)) - 1) / 24 END AS aroon_down""", "x")))
def ind_aroon(spark, sf):
    return show(t.bars(spark, sf).withColumns(ind.aroon(25)), "aroon_up", "aroon_down")


@query("2.5.27 2.13.1", sql(body(rs("cci")), SM,
       layer("x", "(high + low + close) / 3 AS tp"),
       layer("y", f"list(tp) {rows(20)} AS tps, {gate('avg', 'tp', 20)} AS m", "x"),
       layer("q", "(tp - m) / nullif(0.015 * list_avg(list_transform(tps, lambda v: abs(v - m))), 0) AS cci", "y")))
def ind_cci(spark, sf):
    return show(t.bars(spark, sf).withColumn("cci", ind.cci(20)), "cci")


@query("2.5.28 2.5.29 2.5.30 2.5.31", sql(body(rs("roc", "momentum", "std_20", "std_annual", "awesome")), SM,
       layer("x", f"close / lag(close) {LAG} - 1 AS ret, (high + low) / 2 AS hl"),
       layer("q", f"""100 * (close / lag(close, 12) {LAG} - 1) AS roc, close - lag(close, 10) {LAG} AS momentum,
         {gate('stddev_samp', 'ret', 20)} AS std_20, {gate('stddev_samp', 'ret', 20)} * sqrt(252) AS std_annual,
         {gate('avg', 'hl', 5)} - {gate('avg', 'hl', 34)} AS awesome""", "x")))
def ind_momentum_family(spark, sf):
    b = t.bars(spark, sf).withColumn("ret", ratio("close", W.shift("close")) - 1.0)
    b = b.withColumns({"roc": ind.roc(), "momentum": ind.momentum(), "std_20": ind.return_std(20),
                       "std_annual": ind.return_std(20, annualise=True), "awesome": ind.awesome()})
    return show(b, "roc", "momentum", "std_20", "std_annual", "awesome")


def uo(n: int) -> str:
    return f"{gate('sum', 'bp', n)} / nullif({gate('sum', 'rg', n)}, 0)"


@query("2.5.32", sql(body(rs("ultimate")), SM,
       layer("x0", f"lag(close) {LAG} AS pc"),
       layer("x", "close - least(low, pc) AS bp, greatest(high, pc) - least(low, pc) AS rg",
             "(SELECT * FROM x0) x1").replace("close - least", "CASE WHEN close IS NOT NULL THEN close END - least")
       .replace("greatest(high, pc) -", "CASE WHEN close IS NOT NULL THEN greatest(high, pc) END -"),
       layer("q", f"100 * (4 * {uo(7)} + 2 * {uo(14)} + {uo(28)}) / 7 AS ultimate", "x")))
def ind_ultimate(spark, sf):
    return show(ind.ultimate(t.bars(spark, sf)), "ultimate")


@query("2.5.33", sql(body(rs("tenkan", "kijun", "senkou_a", "senkou_b")), SM,
       layer("x", f"({HH(9)} + {LL(9)}) / 2 AS tenkan, ({HH(26)} + {LL(26)}) / 2 AS kijun, ({HH(52)} + {LL(52)}) / 2 AS senkou_b"),
       layer("q", "(tenkan + kijun) / 2 AS senkou_a", "x")))
def ind_ichimoku(spark, sf):
    return show(t.bars(spark, sf).withColumns(ind.ichimoku()), "tenkan", "kijun", "senkou_a", "senkou_b")


SAR_SQL = """walk AS (WITH RECURSIVE b AS (SELECT symbol, idx, high, low, lag(high) OVER s AS h1, lag(low) OVER s AS l1,
        lag(high, 2) OVER s AS h2, lag(low, 2) OVER s AS l2 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY idx)),
      f AS (SELECT b.symbol, b.idx, CASE WHEN high >= h1 THEN 1 ELSE -1 END AS side,
            CASE WHEN high >= h1 THEN l1 ELSE h1 END AS sar, CASE WHEN high >= h1 THEN high ELSE low END AS ep,
            CAST(0.02 AS DOUBLE) AS af FROM b WHERE idx = 1 AND symbol IN (SELECT symbol FROM bars WHERE idx = 0)
        UNION ALL
        SELECT symbol, idx, CASE WHEN flip THEN -side ELSE side END,
          CASE WHEN flip THEN ep ELSE nxt END,
          CASE WHEN flip THEN (CASE WHEN side = 1 THEN low ELSE high END) WHEN ext THEN (CASE WHEN side = 1 THEN high ELSE low END) ELSE ep END,
          CASE WHEN flip THEN 0.02 WHEN ext THEN least(af + 0.02, 0.2) ELSE af END
        FROM (SELECT *, CASE WHEN side = 1 THEN low < nxt ELSE high > nxt END AS flip,
                CASE WHEN side = 1 THEN high > ep ELSE low < ep END AS ext
              FROM (SELECT b.*, f.side, f.ep, f.af,
                  CASE WHEN side = 1 THEN least(f.sar + f.af * (f.ep - f.sar), l1, l2)
                       ELSE greatest(f.sar + f.af * (f.ep - f.sar), h1, h2) END AS nxt
                FROM f JOIN b ON b.symbol = f.symbol AND b.idx = f.idx + 1)))
      SELECT symbol, idx, sar, side FROM f)"""


@query("2.5.34", sql(f"""SELECT symbol, {day('session')}, {r('sar', 'sar')}, CAST(coalesce(side, 0) AS BIGINT) AS sar_side
       FROM bars LEFT JOIN walk USING (symbol, idx)""", SM, SAR_SQL))
def ind_parabolic_sar(spark, sf):
    return show(states.parabolic_sar(t.bars(spark, sf)), "sar", "sar_side")


@query("2.5.35 2.5.51", sql(body(rs("rsi")), SM, layer("x0", f"close - lag(close) {LAG} AS d"),
       layer("x", "CASE WHEN d > 0 THEN d WHEN d <= 0 THEN 0.0 END AS g, CASE WHEN d < 0 THEN -d WHEN d >= 0 THEN 0.0 END AS l", "x0"),
       sql_ewm("x", "e", eg=("g", "1.0/14"), el=("l", "1.0/14")),
       "q AS (SELECT x.*, 100 - 100 / (1 + eg / nullif(el, 0)) AS rsi FROM x JOIN e USING (symbol, idx))"))
def ind_rsi(spark, sf):
    return show(ind.rsi(t.bars(spark, sf)), "rsi")


ST_SQL = [layer("x", TR), sql_ewm("x", "e", atr=("tr", "1.0/10")),
          """sb AS (SELECT x.symbol, x.session, x.close, row_number() OVER s AS rn, (high + low) / 2 + 3 * atr AS t,
                (high + low) / 2 - 3 * atr AS b, lag(x.close) OVER s AS pc
              FROM x JOIN e USING (symbol, idx) WHERE x.close IS NOT NULL WINDOW s AS (PARTITION BY symbol ORDER BY idx))""",
          """walk AS (WITH RECURSIVE f AS (SELECT symbol, session, rn, t AS ft, b AS fb, 1 AS side, t AS st FROM sb WHERE rn = 1
              UNION ALL SELECT symbol, session, rn, ft, fb, sd, CASE WHEN sd = 1 THEN fb ELSE ft END FROM (
                SELECT *, CASE WHEN side = 1 THEN (CASE WHEN close < fb THEN -1 ELSE 1 END)
                               ELSE (CASE WHEN close > ft THEN 1 ELSE -1 END) END AS sd
                FROM (SELECT sb.symbol, sb.session, sb.rn, sb.close, f.side,
                    CASE WHEN sb.t < f.ft OR sb.pc > f.ft THEN sb.t ELSE f.ft END AS ft,
                    CASE WHEN sb.b > f.fb OR sb.pc < f.fb THEN sb.b ELSE f.fb END AS fb
                  FROM f JOIN sb ON sb.symbol = f.symbol AND sb.rn = f.rn + 1)))
             SELECT * FROM f)"""]


@query("2.5.36", sql(f"SELECT symbol, {day('session')}, {r('st', 'supertrend')}, CAST(side AS BIGINT) AS st_side FROM walk",
       SM, ST_SQL))
def ind_supertrend(spark, sf):
    return show(states.supertrend(ind.atr(t.bars(spark, sf), 10)), "supertrend", "st_side")


@query("2.5.37 2.5.38 2.5.50", sql(body(rs("donchian_high", "donchian_low", "top_close", "low_volume")), SM,
       layer("q", f"""{gate('max', 'high', 20, prior(20))} AS donchian_high, {gate('min', 'low', 20, prior(20))} AS donchian_low,
        {gate('max', 'close', 10, prior(10))} AS top_close, {gate('min', 'volume', 10, prior(10))} AS low_volume""")))
def ind_donchian(spark, sf):
    b = t.bars(spark, sf).withColumns({**ind.donchian(20), "top_close": ind.extreme_prior("close", 10, "highest"),
                                       "low_volume": ind.extreme_prior("volume", 10, "lowest")})
    return show(b, "donchian_high", "donchian_low", "top_close", "low_volume")


RULE_SQL = f"""CAST(coalesce(close > {gate('max', 'high', 20, prior(20))}, false) AS INTEGER) AS donchian_breakout,
     CAST(coalesce(fast > slow AND lag(fast) {LAG} <= lag(slow) {LAG}, false) AS INTEGER) AS sma_cross,
     CAST(coalesce(macd > macd_signal AND lag(macd) {LAG} <= lag(macd_signal) {LAG}, false) AS INTEGER) AS macd_cross,
     CAST(coalesce(close > lo AND lag(close) {LAG} <= lag(lo) {LAG}, false) AS INTEGER) AS bollinger_reversion"""


@query("2.5.40 2.5.41 2.6.25 2.13.4", sql(body("donchian_breakout, sma_cross, macd_cross, bollinger_reversion", "w"), SM,
       MACD_SQL,
       layer("v", f"{gate('avg', 'close', 5)} AS fast, {gate('avg', 'close', 20)} AS slow, "
                  f"{gate('avg', 'close', 20)} - 2 * {gate('stddev_pop', 'close', 20)} AS lo", "q"),
       layer("w", RULE_SQL, "v")))
def preset_signals(spark, sf):
    keys = ("donchian_breakout", "sma_cross", "macd_cross", "bollinger_reversion")
    b = densify(t.bars(spark, sf))
    for key in keys:
        b = presets.with_indicators(b, presets.RULES[key].indicators)
        b = b.withColumn(key, presets.fires(presets.RULES[key]).cast("int"))
    return show(b.where("traded"), *keys)


@query("2.5.68", sql(f"""SELECT symbol, {day('session')}, {rs('roc', 'stoch_k', 'donchian_high')} FROM q
       WHERE idx = (SELECT max(b.idx) FROM bars b WHERE b.symbol = q.symbol)""", SM, layer("q",
       f"""100 * (close / lag(close, 12) {LAG} - 1) AS roc, 100 * (close - {LL(14)}) / nullif({HH(14)} - {LL(14)}, 0) AS stoch_k,
           {gate('max', 'high', 20, prior(20))} AS donchian_high""")))
def ind_latest_values(spark, sf):
    b = t.bars(spark, sf).withColumns({"roc": ind.roc(), "stoch_k": ind.stochastic_k(), **ind.donchian(20)})
    return show(ind.latest_per_symbol(b, ["roc", "stoch_k", "donchian_high"]), "roc", "stoch_k", "donchian_high")


@query("2.5.61 2.5.43", sql(body(rs("ret_1", "diff_1", "volume_run", "high_run")), SM, layer("q",
       f"""close / lag(close) {LAG} - 1 AS ret_1, close - lag(close) {LAG} AS diff_1,
           sum(volume) OVER (PARTITION BY symbol ORDER BY idx) AS volume_run,
           max(high) OVER (PARTITION BY symbol ORDER BY idx) AS high_run""")))
def ind_previous_row(spark, sf):
    pc = W.shift("close")
    b = t.bars(spark, sf).withColumns({"ret_1": ratio("close", pc) - 1.0, "diff_1": F.col("close") - pc,
                                       "volume_run": F.sum("volume").over(W.so_far()),
                                       "high_run": F.max("high").over(W.so_far())})
    return show(b, "ret_1", "diff_1", "volume_run", "high_run")
