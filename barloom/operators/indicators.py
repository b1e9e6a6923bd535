"""Technical indicators over a sparse indexed panel.

Functions return Columns built from the shared frames, so any set of them added
in one ``select`` runs in one window pass; those needing exponential smoothing
take and return DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import frames as W
from ..functions.ewm import ewm, span_alpha, wilder_alpha
from ..functions.order_stats import Quantile, Rank, with_order_stats
from ..functions.scalars import col, finite, ratio, truth

SESSIONS_PER_YEAR = 252


class IndicatorError(ValueError):
    """A parameter combination that has no meaning."""


# ---- trend ---------------------------------------------------------------

def macd(df: DataFrame, c="close", fast: int = 12, slow: int = 26, signal: int = 9, **kw) -> DataFrame:
    if fast >= slow:
        raise IndicatorError("fast span must be shorter than slow")
    df = ewm(df, {"macd_fast": (c, span_alpha(fast)), "macd_slow": (c, span_alpha(slow))}, **kw)
    df = df.withColumn("macd", F.col("macd_fast") - F.col("macd_slow"))
    df = ewm(df, {"macd_signal": ("macd", span_alpha(signal))}, hold=True, **kw)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("macd_fast", "macd_slow")


def ema(df: DataFrame, spans, c="close", **kw) -> DataFrame:
    return ewm(df, {f"ema_{n}": (c, span_alpha(n)) for n in spans}, **kw)


# ---- volume --------------------------------------------------------------

def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def session_vwap(by=("symbol", "session"), at="bar_ts") -> Column:
    """Running value over running volume within a symbol's session."""
    w = W.so_far(list(by), at)
    return ratio(F.sum(typical() * F.col("volume")).over(w), F.sum("volume").over(w))


def rolling_vwap(n: int = 20) -> Column:
    pv = typical() * F.col("volume")
    return ratio(W.rolling(F.sum, pv, n), W.rolling(F.sum, "volume", n))


def relative_volume(n: int = 20) -> Column:
    return ratio("volume", W.rolling_prior(F.avg, "volume", n))


# ---- volatility ----------------------------------------------------------

def true_range() -> Column:
    pc = W.shift("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def atr(df: DataFrame, n: int = 14, smoothing: str = "wilder", out: str = "atr", **kw) -> DataFrame:
    df = df.withColumn("true_range", true_range())
    if smoothing == "sma":
        return df.withColumn(out, W.sma("true_range", n))
    if smoothing != "wilder":
        raise IndicatorError(f"unknown smoothing {smoothing}")
    return ewm(df, {out: ("true_range", wilder_alpha(n))}, **kw)


def bollinger(c="close", n: int = 20, k: float = 2.0, sample: bool = True) -> dict[str, Column]:
    mid = W.sma(c, n)
    sd = W.rolling(F.stddev_samp if sample else F.stddev_pop, c, n)
    return {"bb_upper": mid + k * sd, "bb_mid": mid, "bb_lower": mid - k * sd,
            "bb_width_pct": 100.0 * ratio(2 * k * sd, mid)}


def compressed(df: DataFrame, width="bb_width_pct", q: float = 0.2, n: int = 120,
               need: int | None = None) -> DataFrame:
    df = with_order_stats(df, {"__edge": Quantile(width, q, n, need)})
    return df.withColumn("compressed", truth(F.col(width) <= F.col("__edge"))).drop("__edge")


def return_std(n: int = 20, annualise: bool = False, c="ret") -> Column:
    sd = W.rolling(F.stddev_samp, c, n)
    return sd * (SESSIONS_PER_YEAR ** 0.5) if annualise else sd


# ---- structure -----------------------------------------------------------

def gap_pct() -> Column:
    return 100.0 * (ratio("open", W.shift("close")) - 1.0)


def gap_class(g: Column, threshold: float = 2.0) -> Column:
    return F.when(g >= threshold, "up").when(g <= -threshold, "down").otherwise("none")


def swing_points(window: int = 3) -> dict[str, Column]:
    """Strict pivots: the only extreme of a full window on both sides."""
    w = W.around(window)
    need = 2 * window + 1

    def sole(c, agg):
        seen = F.collect_list(c).over(w)
        return truth((F.count(c).over(w) == need) & (F.col(c) == agg(c).over(w))
                     & (F.size(F.filter(seen, lambda v: v == F.col(c))) == 1))

    return {"swing_high": sole("high", F.max), "swing_low": sole("low", F.min)}


def market_structure(df: DataFrame, window: int = 3) -> DataFrame:
    """Each pivot labelled against the previous pivot of its own kind."""
    p = df.withColumns(swing_points(window))
    w = Window.partitionBy("symbol", "kind").orderBy("idx")
    kinds = F.array(F.when(F.col("swing_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("level"))),
                    F.when(F.col("swing_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("level"))))
    rows = (p.select("symbol", "session", "idx", F.explode(F.array_compact(kinds)).alias("p"))
            .select("symbol", "session", "idx", "p.kind", "p.level"))
    prev = F.lag("level").over(w)
    label = (F.when(prev.isNull(), None)
             .when(F.col("kind") == "high", F.when(F.col("level") > prev, "HH").otherwise("LH"))
             .otherwise(F.when(F.col("level") > prev, "HL").otherwise("LL")))
    return rows.withColumn("label", label)


def structure_bias(ms: DataFrame) -> DataFrame:
    """Bias per symbol from its last high label and last low label."""
    g = ms.where(F.col("label").isNotNull()).groupBy("symbol").agg(
        F.max_by(F.when(F.col("kind") == "high", F.col("label")),
                 F.when(F.col("kind") == "high", F.col("idx"))).alias("last_high"),
        F.max_by(F.when(F.col("kind") == "low", F.col("label")),
                 F.when(F.col("kind") == "low", F.col("idx"))).alias("last_low"))
    hi, lo = F.col("last_high"), F.col("last_low")
    return g.withColumn("bias", F.when((hi == "HH") & (lo == "HL"), "uptrend")
                        .when((hi == "LH") & (lo == "LL"), "downtrend")
                        .when(hi.isNotNull() & lo.isNotNull(), "mixed").otherwise("unknown"))


# ---- directional ---------------------------------------------------------

def directional_movement(first_zero: bool = False) -> dict[str, Column]:
    """At most one of the two is non-zero; a row without a previous one is NULL
    (or zero in the single-series variant)."""
    up, down = F.col("high") - W.shift("high"), W.shift("low") - F.col("low")
    none = F.lit(0.0) if first_zero else F.lit(None).cast("double")
    known = up.isNotNull() & down.isNotNull()

    def side(a, b):
        return F.when(known, F.when((a > b) & (a > 0), a).otherwise(0.0)).otherwise(none)

    return {"plus_dm": side(up, down), "minus_dm": side(down, up)}


def adx(df: DataFrame, n: int = 14, first_zero: bool = False, smoothing: str = "wilder", **kw) -> DataFrame:
    """Trend strength with both directional lines; NULL where undefined."""
    df = df.withColumns({"__tr": true_range(), **directional_movement(first_zero)})
    names = {"adx_tr": "__tr", "adx_up": "plus_dm", "adx_dn": "minus_dm"}
    if smoothing == "sma":
        df = df.withColumns({o: W.sma(c, n) for o, c in names.items()})
    else:
        df = ewm(df, {o: (c, wilder_alpha(n)) for o, c in names.items()}, **kw)
    rng = F.when(F.col("adx_tr") > 0, F.col("adx_tr"))
    df = df.withColumns({"plus_di": 100.0 * F.col("adx_up") / rng,
                         "minus_di": 100.0 * F.col("adx_dn") / rng})
    both = F.col("plus_di") + F.col("minus_di")
    df = df.withColumn("dx", 100.0 * F.abs(F.col("plus_di") - F.col("minus_di")) / F.when(both > 0, both))
    if smoothing == "sma":
        df = df.withColumn("adx", W.sma("dx", n))
    else:
        df = ewm(df, {"adx": ("dx", wilder_alpha(n))}, hold=True, **kw)
    return df.drop("adx_tr", "adx_up", "adx_dn", "__tr")


# ---- oscillators ---------------------------------------------------------

def rsi(df: DataFrame, n: int = 14, c="close", smoothing: str = "wilder", out: str = "rsi", **kw) -> DataFrame:
    """Undefined (NULL) when the window has no down move."""
    d = col(c) - W.shift(c)
    df = df.withColumns({"__gain": F.greatest(d, F.lit(0.0)) + d * 0, "__loss": F.greatest(-d, F.lit(0.0)) + d * 0})
    if smoothing == "sma":
        df = df.withColumns({"rsi_g": W.sma("__gain", n), "rsi_l": W.sma("__loss", n)})
    else:
        df = ewm(df, {"rsi_g": ("__gain", wilder_alpha(n)), "rsi_l": ("__loss", wilder_alpha(n))}, **kw)
    rs = ratio("rsi_g", "rsi_l")
    return df.withColumn(out, 100.0 - 100.0 / (1.0 + rs)).drop("rsi_g", "rsi_l", "__gain", "__loss")


def _extremes(n: int):
    return W.rolling(F.max, "high", n), W.rolling(F.min, "low", n)


def stochastic_k(n: int = 14) -> Column:
    hh, ll = _extremes(n)
    return 100.0 * ratio(F.col("close") - ll, hh - ll)


def williams_r(n: int = 14) -> Column:
    hh, ll = _extremes(n)
    return -100.0 * ratio(hh - F.col("close"), hh - ll)


def aroon(n: int = 25) -> dict[str, Column]:
    """Position of the first extreme in the window, scaled to 0..100."""
    w = W.last_n(n)

    def since(c, key):
        at = F.min_by(F.col("idx"), F.when(F.col(c).isNotNull(), F.struct(key, F.col("idx")))).over(w)
        pos = (n - 1) - (F.col("idx") - at)
        return F.when(F.count(c).over(w) >= n, 100.0 * pos / (n - 1))

    up, down = since("high", -F.col("high")), since("low", F.col("low"))
    return {"aroon_up": up, "aroon_down": down, "aroon_osc": up - down}


def cci(n: int = 20, constant: float = 0.015) -> Column:
    """Mean absolute deviation is taken about the window's own mean."""
    tp, w = typical(), W.last_n(n)
    mean = F.avg(tp).over(w)
    seen = F.collect_list(tp).over(w)
    mad = F.aggregate(seen, F.lit(0.0), lambda acc, x: acc + F.abs(x - mean)) / F.count(tp).over(w)
    return F.when(F.count(tp).over(w) >= n, ratio(tp - mean, constant * mad))


def roc(n: int = 12) -> Column:
    return 100.0 * (ratio("close", W.shift("close", n)) - 1.0)


def momentum(n: int = 10) -> Column:
    return F.col("close") - W.shift("close", n)


def awesome(fast: int = 5, slow: int = 34) -> Column:
    mid = (F.col("high") + F.col("low")) / 2.0
    return W.sma(mid, fast) - W.sma(mid, slow)


def ultimate(df: DataFrame, short: int = 7, medium: int = 14, long: int = 28) -> DataFrame:
    """Weighted 4:2:1 buying pressure over true range. The first bar of a
    symbol has no previous close and uses its own range."""
    pc = W.shift("close")
    low = F.least("low", pc)
    df = df.withColumns({"__bp": F.col("close") - low, "__rg": F.greatest("high", pc) - low})

    def part(n):
        return ratio(W.rolling(F.sum, "__bp", n), W.rolling(F.sum, "__rg", n))

    uo = 100.0 * (4 * part(short) + 2 * part(medium) + part(long)) / 7.0
    return df.withColumn("ultimate", uo).drop("__bp", "__rg")


def ichimoku(tenkan: int = 9, kijun: int = 26, senkou_b: int = 52) -> dict[str, Column]:
    """Mid-ranges; the spans sit on the bar they are computed from."""
    def mid(n):
        hh, ll = _extremes(n)
        return (hh + ll) / 2.0
    t, k = mid(tenkan), mid(kijun)
    return {"tenkan": t, "kijun": k, "senkou_a": (t + k) / 2.0, "senkou_b": mid(senkou_b)}


def donchian(n: int) -> dict[str, Column]:
    """Channel of the previous n sessions; today stays outside."""
    return {"donchian_high": W.rolling_prior(F.max, "high", n),
            "donchian_low": W.rolling_prior(F.min, "low", n)}


def extreme_prior(c, n: int, want: str) -> Column:
    return W.rolling_prior(F.max if want == "highest" else F.min, c, n)


# ---- relative strength ---------------------------------------------------

def with_benchmark(df: DataFrame, bench: DataFrame, fill: bool = False) -> DataFrame:
    """Join one benchmark value per session (a calendar-sized table).

    ``fill`` carries the last benchmark value over sessions it lacks; otherwise
    only shared sessions remain.
    """
    if not fill:
        return df.join(bench, "session")
    days = df.select("session").distinct().join(bench, "session", "left")
    carried = days.select("session", F.last("bench", ignorenulls=True).over(
        Window.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)).alias("bench"))
    return df.join(carried, "session", "left")


def rs_line(c="close") -> Column:
    return finite(ratio(c, "bench"))


def rs_rank(df: DataFrame, n: int = 63, c: str = "rs", out: str = "rs_rank") -> DataFrame:
    return with_order_stats(df, {out: Rank(c, n, ties="max")}).withColumn(out, 100.0 * F.col(out))


# ---- latest values ------------------------------------------------------

def latest_per_symbol(df: DataFrame, cols) -> DataFrame:
    """Last row of each symbol for the given columns, one partial aggregation."""
    return (df.groupBy("symbol").agg(F.max_by(F.struct("session", *cols), F.col("idx")).alias("r"))
            .select("symbol", "r.*"))
