"""The feature table: one row per symbol at a date, or per symbol and session.

Two forms with the same values. ``stage1`` answers for one date: everything that
only looks at the last n sessions becomes a conditional aggregate, so a whole
universe costs one shuffle on ``symbol`` and one pass. ``stage1_series`` gives
the columns at every session at once, which is what a replay over history needs
instead of a loop over dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import frames as W
from ..functions.ewm import ewm, wilder_alpha
from ..functions.order_stats import Quantile, Rank, with_order_stats
from ..functions.scalars import finite, price, truth
from .indicators import directional_movement, true_range, with_benchmark

# Report order of the feature columns.
FEATURES = (
    "bars", "close", "volume", "ret_1d_pct", "ret_5d_pct", "ret_20d_pct", "rel_volume", "gap_pct",
    "atr_pct", "atr_pct_rank", "dist_sma20_pct", "dist_sma50_pct", "dist_sma200_pct",
    "pos_52w_pct", "high_52w", "low_52w", "swing_low", "swing_low_age", "low_20",
    "prior_high_20", "prior_low_10", "bb_width_pct", "bb_mid", "bb_lower", "rsi_14", "compressed",
    "rs_rank", "unusual_volume", "unusual_move", "near_52w_high", "extended", "flag_count",
    "adx_14", "plus_di_14", "minus_di_14")

A14 = wilder_alpha(14)


def unadjusted(bars: DataFrame, actions: DataFrame, as_of) -> DataFrame:
    """Price-changing actions per symbol inside the loaded window.

    A factor of exactly one is a dividend and moves nothing; a missing factor
    counts as one.
    """
    first = bars.agg(F.min("session")).scalar()
    return (actions.where((F.col("ex_date") >= first) & (F.col("ex_date") <= F.lit(as_of).cast("date"))
                          & (F.coalesce("factor", F.lit(1.0)) != 1.0))
            .join(bars.select("symbol").distinct(), "symbol", "left_semi")
            .groupBy("symbol").agg(F.count(F.lit(1)).alias("actions")))


def exclusions(bars: DataFrame, actions: DataFrame | None, as_of, min_bars: int = 30) -> DataFrame:
    """Each symbol with the reason it is left out, or NULL when it stays."""
    n = bars.groupBy("symbol").agg(F.count("close").alias("bars"))
    hit = (F.lit(None).cast("long") if actions is None else F.col("actions"))
    if actions is not None:
        n = n.join(unadjusted(bars, actions, as_of), "symbol", "left")
    return n.select("symbol", "bars", F.when(hit > 0, "unadjusted corporate action in window")
                    .when(F.col("bars") < min_bars, f"fewer than {min_bars} bars").alias("reason"))


def smoothed(df: DataFrame) -> DataFrame:
    """Every recursive quantity in two smoothing passes (inputs, then DX)."""
    d = F.col("close") - W.shift("close")
    df = df.withColumns({"__tr": true_range(), "__d": d, **directional_movement()})
    df = df.withColumns({"__up": F.when(F.col("__d").isNotNull(), F.greatest("__d", F.lit(0.0))),
                         "__dn": F.when(F.col("__d").isNotNull(), F.greatest(-F.col("__d"), F.lit(0.0)))})
    df = df.withColumnsRenamed({"__tr": "tr", "__up": "up", "__dn": "dn"}).drop("__d")
    df = ewm(df, {"atr": ("tr", A14), "sm_plus": ("plus_dm", A14), "sm_minus": ("minus_dm", A14),
                  "gain": ("up", A14), "loss": ("dn", A14)})
    rng = F.when(F.col("atr") > 0, F.col("atr"))
    df = df.withColumns({"plus_di_14": finite(100.0 * F.col("sm_plus") / rng),
                         "minus_di_14": finite(100.0 * F.col("sm_minus") / rng)})
    both = F.col("plus_di_14") + F.col("minus_di_14")
    df = df.withColumn("dx", 100.0 * F.abs(F.col("plus_di_14") - F.col("minus_di_14"))
                       / F.when(both > 0, both))
    df = ewm(df, {"adx_14": ("dx", A14)}, hold=True)
    rs = F.col("gain") / F.when(F.col("loss") != 0, F.col("loss"))
    return df.withColumns({"rsi_14": 100.0 - 100.0 / (1.0 + rs),
                           "atr_pct": finite(100.0 * F.col("atr") / price("close"))}
                          ).drop("tr", "up", "dn", "plus_dm", "minus_dm", "sm_plus", "sm_minus", "gain", "loss")


def _flags(df: DataFrame, rel_volume: float, move_atrs: float, near_high: float,
           extended_atrs: float) -> DataFrame:
    df = df.withColumns({
        "unusual_volume": truth(F.col("rel_volume") >= rel_volume),
        "unusual_move": truth(F.abs("ret_1d_pct") >= move_atrs * F.col("atr_pct")),
        "near_52w_high": truth(F.col("pos_52w_pct") >= near_high),
        "extended": truth(F.col("dist_sma20_pct") >= extended_atrs * F.col("atr_pct"))})
    counted = ("unusual_volume", "unusual_move", "near_52w_high", "compressed")
    return df.withColumn("flag_count", sum((F.col(c).cast("long") for c in counted), F.lit(0).cast("long")))


def _swing_low(window: int) -> Column:
    """Low of a bar no lower bar surrounds; ties allowed, full window needed."""
    around = W.around(window)
    return F.when((F.count("low").over(around) == 2 * window + 1)
                  & (F.col("low") == F.min("low").over(around)), F.col("low"))


def _with_rs(p: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    if benchmark is None:
        return p.withColumn("rs", F.lit(None).cast("double"))
    p = with_benchmark(p, benchmark, fill=True)
    return p.withColumn("rs", F.col("close") / price("bench")).drop("bench")


def stage1(bars: DataFrame, as_of=None, benchmark: DataFrame | None = None,
           actions: DataFrame | None = None, min_bars: int = 30, swing_window: int = 3,
           rel_volume: float = 2.0, move_atrs: float = 1.5, near_high: float = 95.0,
           extended_atrs: float = 4.0) -> DataFrame:
    """Features of every symbol at ``as_of``; NULL wherever a window is short."""
    src = bars if as_of is None else bars.where(F.col("session") <= F.lit(as_of).cast("date"))
    T = src.agg(F.max("idx")).scalar()
    p = src.select("symbol", "session", "idx", "open", "high", "low", "close", "volume")
    if actions is not None:
        cutoff = as_of if as_of is not None else src.agg(F.max("session")).scalar()
        p = p.join(unadjusted(src, actions, cutoff), "symbol", "left_anti")
    # joined before any window: the benchmark is calendar-sized and rides along
    p = _with_rs(p, benchmark).withColumn("ago", T - F.col("idx"))
    p = smoothed(p)
    mid, sd = W.sma("close", 20), W.rolling(F.stddev_samp, "close", 20)
    p = p.withColumns({"mid": mid, "sd": sd, "swing": _swing_low(swing_window)})
    p = p.withColumn("width", 100.0 * 4.0 * F.col("sd") / price("mid"))
    ago = F.col("ago")

    def at(c, k=0):
        return F.max(F.when(ago == k, F.col(c)))

    def within(agg, c, n, skip=0, need=None):
        v = F.when((ago >= skip) & (ago < n + skip), F.col(c))
        return F.when(F.count(v) >= (need or n), agg(v))

    def recent(c, n):
        return F.collect_list(F.when(ago < n, F.col(c)))

    def standing(seen, now, need):
        lower, same = (F.size(F.filter(seen, f)) for f in (lambda v: v < now, lambda v: v == now))
        return F.when(now.isNotNull() & (F.size(seen) >= need), 100.0 * (lower + (same + 1) / 2) / F.size(seen))

    newest = F.max(F.struct("idx", "adx_14", "dx", "plus_di_14", "minus_di_14", "rsi_14"))
    pivot = F.max(F.when(F.col("swing").isNotNull(), F.struct("idx", "swing")))
    g = p.groupBy("symbol").agg(
        F.count("close").alias("bars"), at("close").alias("close"), at("volume").alias("volume"),
        *[at("close", k).alias(f"c{k}") for k in (1, 5, 20)], at("open").alias("o0"),
        within(F.avg, "volume", 20, skip=1).alias("vbase"), at("atr_pct").alias("atr_pct"),
        recent("atr_pct", 252).alias("atr_seen"),
        *[within(F.avg, "close", n).alias(f"sma{n}") for n in (20, 50, 200)],
        within(F.max, "high", 252, need=1).alias("high_52w"), within(F.min, "low", 252, need=1).alias("low_52w"),
        pivot.alias("pivot"), within(F.min, "low", 20).alias("low_20"),
        within(F.max, "high", 20, skip=1).alias("prior_high_20"),
        within(F.min, "low", 10, skip=1).alias("prior_low_10"),
        at("width").alias("bb_width_pct"), at("mid").alias("bb_mid"),
        (at("mid") - 2.0 * at("sd")).alias("bb_lower"),
        within(lambda v: F.percentile(v, 0.2), "width", 120, need=40).alias("squeeze"),
        recent("rs", 55).alias("rs_seen"), at("rs").alias("rs_now"), newest.alias("n"))
    still = T - F.col("n.idx")
    drift = F.pow(F.lit(1.0 - A14), still)
    g = g.where(F.col("bars") >= min_bars).withColumns({
        "atr_pct_rank": standing(F.col("atr_seen"), F.col("atr_pct"), 60),
        "rs_rank": standing(F.col("rs_seen"), F.col("rs_now"), 20),
        **{f"ret_{k}d_pct": finite(100.0 * (F.col("close") / price(f"c{k}") - 1.0)) for k in (1, 5, 20)},
        "rel_volume": finite(F.col("volume") / F.when(F.col("vbase") != 0, F.col("vbase"))),
        "gap_pct": finite(100.0 * (F.col("o0") / price("c1") - 1.0)),
        **{f"dist_sma{n}_pct": finite(100.0 * (F.col("close") / price(f"sma{n}") - 1.0)) for n in (20, 50, 200)},
        "pos_52w_pct": finite(100.0 * (F.col("close") - F.col("low_52w"))
                              / F.nullif(F.col("high_52w") - F.col("low_52w"), F.lit(0.0))),
        "swing_low": F.col("pivot.swing"), "swing_low_age": (T - F.col("pivot.idx")).cast("double"),
        "rsi_14": F.col("n.rsi_14"), "plus_di_14": F.col("n.plus_di_14"),
        "minus_di_14": F.col("n.minus_di_14"),
        "adx_14": F.col("n.dx") + (F.col("n.adx_14") - F.col("n.dx")) * drift,
        "compressed": truth(F.col("bb_width_pct") <= F.col("squeeze"))})
    return _flags(g, rel_volume, move_atrs, near_high, extended_atrs).select("symbol", *FEATURES)


def stage1_series(bars: DataFrame, benchmark: DataFrame | None = None, min_bars: int = 30,
                  swing_window: int = 3, rel_volume: float = 2.0, move_atrs: float = 1.5,
                  near_high: float = 95.0, extended_atrs: float = 4.0) -> DataFrame:
    """The same features at every traded session, point-in-time by frame.

    A pivot is only known ``swing_window`` sessions later, so the newest known
    one is carried from that far back.
    """
    p = bars.select("symbol", "session", "idx", "open", "high", "low", "close", "volume")
    p = smoothed(_with_rs(p, benchmark))
    p = p.withColumns({"bb_mid": W.sma("close", 20), "__sd": W.rolling(F.stddev_samp, "close", 20),
                       "__swing": F.struct("idx", _swing_low(swing_window).alias("level"))})
    p = p.withColumn("bb_width_pct", 100.0 * 4.0 * F.col("__sd") / price("bb_mid"))
    known = W.ordered().rangeBetween(Window.unboundedPreceding, -swing_window)
    pivot = F.last(F.when(F.col("__swing.level").isNotNull(), F.col("__swing")), ignorenulls=True).over(known)
    dist = {f"dist_sma{n}_pct": finite(100.0 * (F.col("close") / price(W.sma("close", n)) - 1.0))
            for n in (20, 50, 200)}
    hi, lo = W.rolling(F.max, "high", 252, 1), W.rolling(F.min, "low", 252, 1)
    p = p.withColumns({
        "bars": F.count("close").over(W.so_far()),
        **{f"ret_{k}d_pct": finite(100.0 * (F.col("close") / price(W.shift("close", k)) - 1.0)) for k in (1, 5, 20)},
        "rel_volume": finite(F.col("volume") / F.nullif(W.rolling_prior(F.avg, "volume", 20), F.lit(0.0))),
        "gap_pct": finite(100.0 * (F.col("open") / price(W.shift("close")) - 1.0)),
        **dist,
        "high_52w": hi, "low_52w": lo,
        "low_20": W.rolling(F.min, "low", 20), "prior_high_20": W.rolling_prior(F.max, "high", 20),
        "prior_low_10": W.rolling_prior(F.min, "low", 10), "__pivot": pivot,
        "bb_lower": F.col("bb_mid") - 2.0 * F.col("__sd")})
    # after the windows, whose partitioning and order end here
    p = with_order_stats(p, {"atr_pct_rank": Rank("atr_pct", 252, 60), "rs_rank": Rank("rs", 55, 20), "__squeeze": Quantile("bb_width_pct", 0.2, 120, 40)})
    p = p.withColumns({"atr_pct_rank": 100.0 * F.col("atr_pct_rank"), "rs_rank": 100.0 * F.col("rs_rank"),
                       "compressed": truth(F.col("bb_width_pct") <= F.col("__squeeze")), "swing_low": F.col("__pivot.level"),
                       "swing_low_age": (F.col("idx") - F.col("__pivot.idx")).cast("double"),
                       "pos_52w_pct": finite(100.0 * (F.col("close") - F.col("low_52w"))
                                             / F.nullif(F.col("high_52w") - F.col("low_52w"), F.lit(0.0)))})
    p = _flags(p.where(F.col("bars") >= min_bars), rel_volume, move_atrs, near_high, extended_atrs)
    return p.select("symbol", "session", "idx", *FEATURES)
