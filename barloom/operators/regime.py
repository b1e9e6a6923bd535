"""Market regime at every session from one panel, without a session loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import frames as W
from ..functions.dominance import count_not_above
from ..functions.scalars import truth
from ..functions.selection import with_quantiles
from ..session import cut_lineage

# History floors and thresholds of each dimension.
MIN_SESSIONS, MIN_VOL = 60, 120
BROAD, NARROW = 60.0, 40.0
STRONG, MILD, MIN_SIGMA, FALLBACK = 1.5, 0.4, 1e-6, 0.05
VOL_EXTREME, VOL_ELEVATED, VOL_LOW = 95.0, 80.0, 20.0
JUMP = 0.5


def breadth(panel: DataFrame) -> DataFrame:
    """Share of names above their own 50-session average, per session."""
    p = panel.withColumn("sma50", W.sma("close", 50))
    return p.groupBy("session", "idx").agg(
        F.count("sma50").alias("comparable"), F.count_if(F.col("close") > F.col("sma50")).alias("above"),
        (100.0 * F.try_divide(F.count_if(F.col("close") > F.col("sma50")), F.count("sma50"))).alias("breadth_pct"))


def composite(panel: DataFrame) -> DataFrame:
    """Equal-weight index: mean return of names, jumps beyond a half left out."""
    ret = F.col("close") / F.nullif(W.shift("close"), F.lit(0.0)) - 1.0
    p = panel.withColumn("ret", ret).withColumn("ret", F.when(F.abs("ret") <= JUMP, F.col("ret")))
    day = p.groupBy("session", "idx").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("mean_ret"))
    w = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)   # calendar-sized
    return day.withColumn("composite", F.exp(F.sum(F.log1p("mean_ret")).over(w)))


def regime_series(panel: DataFrame) -> DataFrame:
    """Every dimension and the label at each session, as known that session.

    Two aggregations to the calendar (one per shape of input), then ordered
    windows over a table of sessions.
    """
    d = composite(panel).join(breadth(panel).drop("idx"), "session", "left")
    w = Window.orderBy("idx")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"n": F.row_number().over(w),
                       "daily": F.col("composite") / F.lag("composite").over(w) - 1.0,
                       "change": F.col("composite") / F.lag("composite", 20).over(w) - 1.0,
                       "peak": F.max("composite").over(past)})
    vol_frame = w.rowsBetween(-19, 0)
    d = d.withColumns({"sigma": F.stddev_samp("daily").over(w.rowsBetween(-59, 0)),
                       "vol": F.when(F.count("daily").over(vol_frame) == 20, F.stddev_samp("daily").over(vol_frame))})
    d = cut_lineage(d)  # a row a session; ranked and joined with itself
    d = count_not_above(d, "idx", "vol")
    d = d.withColumns({"vol_pctile": F.when(F.count("vol").over(past) > 0, 100.0 * F.try_divide(F.coalesce("not_above", F.lit(0)), F.count("vol").over(past))),
                       "drawdown_pct": 100.0 * (F.col("composite") / F.col("peak") - 1.0)})
    d = d.withColumn("trend_z", F.when(truth(F.col("sigma") >= MIN_SIGMA), F.col("change") / (F.col("sigma") * 20 ** 0.5))
                     .otherwise(F.col("change") / FALLBACK))
    ready = F.col("n") >= MIN_SESSIONS
    z, vp, b, dd = (F.col(c) for c in ("trend_z", "vol_pctile", "breadth_pct", "drawdown_pct"))
    d = d.withColumns({
        "trend": F.when(ready, F.when(z >= STRONG, "strong_up").when(z >= MILD, "up").when(z <= -STRONG, "strong_down")
                        .when(z <= -MILD, "down").when(z.isNotNull(), "flat")),
        "volatility": F.when(ready & (F.col("n") - 1 >= MIN_VOL), F.when(vp >= VOL_EXTREME, "extreme").when(vp >= VOL_ELEVATED, "elevated")
                             .when(vp <= VOL_LOW, "low").when(vp.isNotNull(), "normal")),
        "breadth": F.when(ready, F.when(b > BROAD, "broad").when(b < NARROW, "narrow").when(b.isNotNull(), "neutral")),
        "risk_appetite": F.when(ready, F.when((dd <= -10) & (F.coalesce(b, F.lit(0.0)) < NARROW), "risk_off")
                                .when((dd >= -3) & (b > BROAD), "risk_on").otherwise("neutral"))})
    dims = ("trend", "volatility", "breadth", "risk_appetite")
    d = d.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in dims})
    return d.withColumn("label", label()).select("session", "idx", "composite", "breadth_pct", "trend_z", "vol_pctile",
                                                 "drawdown_pct", *dims, "label")


def label() -> Column:
    """Crisis over high volatility over direction over range."""
    return (F.when((F.col("volatility") == "extreme") | (F.col("risk_appetite") == "risk_off"), "crisis")
            .when(F.col("volatility") == "elevated", "high_vol")
            .when(F.col("trend").isin("strong_up", "up"), "trending_up")
            .when(F.col("trend").isin("strong_down", "down"), "trending_down")
            .when(F.col("trend") == "flat", "range").otherwise("unknown"))


def sector_medians(panel: DataFrame, sectors: DataFrame, n: int = 20, min_names: int = 3, top: int = 3) -> DataFrame:
    """Median n-session return per industry and session, leading and lagging."""
    p = panel.withColumn("change", F.col("close") / F.nullif(W.shift("close", n), F.lit(0.0)) - 1.0)
    g = (p.join(sectors.select("symbol", "industry"), "symbol").where("change IS NOT NULL")
         .select("session", "industry", "change"))
    g = with_quantiles(g.groupBy("session", "industry").agg(F.count("change").alias("names")).where(F.col("names") >= min_names),
                       g, ["session", "industry"], "change", {"median_change": 0.5}).select("session", "industry", "median_change", "names")
    w = Window.partitionBy("session")
    hi = F.row_number().over(w.orderBy(F.desc("median_change"), "industry"))
    lo = F.row_number().over(w.orderBy("median_change", F.desc("industry")))
    return g.withColumns({"lead_rank": hi, "lag_rank": lo}).where((F.col("lead_rank") <= top) | (F.col("lag_rank") <= top))


def index_gate(panel: DataFrame, n: int = 50) -> DataFrame:
    """Equal-weight price average above its own n-session mean, per session."""
    day = panel.groupBy("session", "idx").agg(F.avg("close").alias("ew"))
    w = Window.orderBy("idx").rowsBetween(-(n - 1), 0)
    mean = F.when(F.count("ew").over(w) == n, F.avg("ew").over(w))
    return day.withColumn("gate", truth(F.col("ew") > mean))


def window_comparison(panel: DataFrame, windows: int = 4, periods: int = 252) -> DataFrame:
    """Advance share, share of sessions above the average, volatility and return per window."""
    ret = F.col("close") / F.nullif(W.shift("close"), F.lit(0.0)) - 1.0
    adv = panel.withColumn("ret", ret).groupBy("session").agg(F.avg(F.when(F.col("ret").isNotNull(), (F.col("ret") > 0).cast("double"))).alias("adv"))
    d = index_gate(panel).join(adv, "session")
    w = Window.orderBy("idx")
    d = d.withColumn("r", F.col("ew") / F.lag("ew").over(w) - 1.0)
    f20 = w.rowsBetween(-19, 0)
    d = d.withColumns({"vol": F.when(F.count("r").over(f20) == 20, F.stddev_samp("r").over(f20) * periods ** 0.5 * 100),
                       "n": F.count(F.lit(1)).over(Window.partitionBy())})
    d = d.withColumn("window", F.floor(F.col("idx") * windows / F.col("n")))
    return d.groupBy("window").agg((100 * F.avg("adv")).alias("advance_pct"), (100 * F.avg(F.col("gate").cast("double"))).alias("above_pct"),
                                   F.avg("vol").alias("vol_pct"), (100 * (F.max_by("ew", "idx") / F.min_by("ew", "idx") - 1)).alias("return_pct"))


def separates(windows: DataFrame, measures, good: str = "good") -> DataFrame:
    """Per measure: do good and bad windows not overlap at all."""
    aggs = []
    for m in measures:
        g, b = F.when(F.col(good), F.col(m)), F.when(~F.col(good), F.col(m))
        aggs.append(F.struct(F.lit(m).alias("measure"), F.avg(g).alias("good_mean"), F.avg(b).alias("bad_mean"),
                             truth((F.min(g) > F.max(b)) | (F.min(b) > F.max(g))).alias("clean")))
    return windows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")
