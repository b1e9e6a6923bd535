"""Pairs: candidates, hedge ratio, walked spread, state, screen with FDR, P&L."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import truth
from ..functions.selection import join_on, with_stretch
from ..functions.tails import adf_stat, tau_p
from ..session import cut_lineage

MIN_OBS, WINDOW = 120, 250


def candidates(turnover: DataFrame, sectors: DataFrame, per_industry: int = 6) -> DataFrame:
    """Pairs among the most traded names of each industry.

    The top-n cut is the feature; it bounds an industry to n(n-1)/2 pairs and
    Spark applies it before the shuffle as a group limit.
    """
    w = Window.partitionBy("industry").orderBy(F.desc("turnover"), "symbol")
    top = (turnover.join(sectors.select("symbol", "industry"), "symbol")
           .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_industry))
    a = top.select("industry", F.col("symbol").alias("y"), F.col("rank").alias("ra"))
    b = top.select("industry", F.col("symbol").alias("x"), F.col("rank").alias("rb"))
    return a.join(b, "industry").where("ra < rb").select("industry", "y", "x")


def aligned(closes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Joint observations of each pair with their position."""
    yv = closes.select(F.col("symbol").alias("y"), "idx", "session", F.col("close").alias("py"))
    xv = closes.select(F.col("symbol").alias("x"), "idx", F.col("close").alias("px"))
    j = pairs.select("y", "x").join(yv, "y").join(xv, ["x", "idx"])
    return j.withColumn("pos", F.row_number().over(Window.partitionBy("y", "x").orderBy("idx")) - 1)


def hedge_ratio(joint: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """Slope and intercept per pair; NULL on few points or a constant leg."""
    g = joint.groupBy("y", "x").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("py", "px").alias("b"), F.regr_intercept("py", "px").alias("a"),
        F.stddev_samp("py").alias("sy"), F.stddev_samp("px").alias("sx"))
    ok = (F.col("n") >= min_obs) & (F.col("sy") > 0) & (F.col("sx") > 0)
    return g.select("y", "x", "n", F.when(ok, F.col("b")).alias("beta"), F.when(ok, F.col("a")).alias("alpha"))


def walk_spread(joint: DataFrame, window: int = WINDOW, refit_every: int = 21) -> DataFrame:
    """Point-in-time z-score of the spread at each bar.

    The hedge is refitted every so many bars on the rows before them and held in
    between; mean and deviation of the trailing spread follow from the moments
    of the two legs on the same frame, so there is one window pass.
    """
    order = Window.partitionBy("y", "x").orderBy("pos")
    back = order.rowsBetween(-window, -1)
    full = F.count("py").over(back) == window
    fit = full & ((F.col("pos") - window) % refit_every == 0)
    d = joint.withColumns({
        "__b": F.when(fit, F.regr_slope("py", "px").over(back)), "__a": F.when(fit, F.regr_intercept("py", "px").over(back)),
        "__my": F.when(full, F.avg("py").over(back)), "__mx": F.avg("px").over(back),
        "__vy": F.var_samp("py").over(back), "__vx": F.var_samp("px").over(back), "__c": F.covar_samp("py", "px").over(back)})
    held = order.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"beta": F.last("__b", ignorenulls=True).over(held), "__al": F.last("__a", ignorenulls=True).over(held)})
    b = F.col("beta")
    var = F.col("__vy") + b * b * F.col("__vx") - 2 * b * F.col("__c")
    now = F.col("py") - b * F.col("px") - F.col("__al")
    mean = F.col("__my") - b * F.col("__mx") - F.col("__al")
    return (d.withColumns({"spread": now, "zscore": (now - mean) / F.sqrt(F.when(var > 0, var))})
            .where("zscore IS NOT NULL").select("y", "x", "idx", "session", "pos", "py", "px", "beta", "spread", "zscore"))


def trailing(joint: DataFrame, window: int) -> DataFrame:
    """The last ``window`` joint observations of each pair."""
    w = Window.partitionBy("y", "x").orderBy(F.desc("pos"))
    return joint.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= window).drop("__r")


def pair_state(joint: DataFrame, window: int = WINDOW, min_obs: int = MIN_OBS) -> DataFrame:
    """Hedge, latest z-score, half-life and cointegration p-value per pair.

    Moments and both regressions are native; only the unit-root statistic of the
    residuals, at most ``window`` numbers per pair, is computed in Python.
    """
    t = trailing(joint, window)
    fit = hedge_ratio(t, min_obs)
    s = t.join(fit, ["y", "x"]).withColumn("spread", F.col("py") - F.col("beta") * F.col("px") - F.col("alpha"))
    prev = F.lag("spread").over(Window.partitionBy("y", "x").orderBy("pos"))
    s = s.withColumns({"prev": prev, "d": F.col("spread") - prev})
    g = s.groupBy("y", "x").agg(
        F.max("n").alias("n_obs"), F.max("beta").alias("beta"), F.max("alpha").alias("alpha"), F.max_by("spread", "pos").alias("spread"),
        F.avg("spread").alias("__m"), F.stddev_samp("spread").alias("__s"),
        F.regr_slope("d", "prev").alias("__k"))
    g = g.select("y", "x", "n_obs", "beta", "alpha", "spread", ((F.col("spread") - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s"))).alias("zscore"),
                 F.when(F.col("__k") < 0, -F.log(F.lit(2.0)) / F.col("__k")).alias("half_life"))

    def coint(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["spread"].to_numpy(float)
        ok = len(x) >= min_obs and np.isfinite(x).all() and np.ptp(x) > 0
        return pd.DataFrame([(key[0], key[1], tau_p(adf_stat(x, constant=False), 2) if ok else None)], columns=["y", "x", "pvalue"])

    p = s.where("spread IS NOT NULL").select("y", "x", "pos", "spread").groupBy("y", "x").applyInPandas(coint, "y string, x string, pvalue double")
    return g.join(p, ["y", "x"], "left")


def screen(states: DataFrame, fdr: float = 0.10, min_half: float = 2.0, max_half: float = 60.0, keys=()) -> DataFrame:
    """Benjamini-Hochberg over all tested pairs, then the reasons to leave a pair out.

    Pairs are dealt by ranges of their p-value. A range's count gives the ranks of
    the next one, its smallest ratio the bound of those before it, so neither
    ranks nor the step-up minimum need all pairs in one task.
    """
    unit = [*keys, "__stretch"]
    d = cut_lineage(with_stretch(states.where("pvalue IS NOT NULL"), "pvalue"))
    whole = Window.partitionBy(*keys).orderBy("__stretch")  # at most 65 rows a family of tests, as are the windows over it
    per = d.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n"))
    per = per.withColumns({"__off": F.coalesce(F.sum("__n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                           "__m": F.sum("__n").over(Window.partitionBy(*keys))})
    inside = Window.partitionBy(*unit).orderBy("pvalue", "y", "x")
    d = join_on(d, per.drop("__n"), unit)
    d = d.withColumn("__k", F.col("__off") + F.row_number().over(inside))
    d = cut_lineage(d.withColumn("__q", F.min(F.col("pvalue") * F.col("__m") / F.col("__k")).over(inside.rowsBetween(0, Window.unboundedFollowing))))
    per = d.groupBy(*unit).agg(F.min("__q").alias("__least"), F.max(F.when(F.col("pvalue") <= F.col("__k") / F.col("__m") * fdr, F.col("__k"))).alias("__last"))
    per = per.withColumns({"__later": F.min("__least").over(whole.rowsBetween(1, Window.unboundedFollowing)),
                           "__cut": F.max("__last").over(Window.partitionBy(*keys))}).select(*unit, "__later", "__cut")
    d = join_on(d, per, unit)
    d = d.withColumns({"qvalue": F.least("__q", "__later", F.lit(1.0)), "__ok": truth(F.col("__k") <= F.col("__cut")), "__k": F.col("__k").cast("int")})
    d = d.drop("__stretch", "__off", "__m", "__q", "__later", "__cut")
    out = d.unionByName(states.where("pvalue IS NULL").withColumns(
        {"qvalue": F.lit(None).cast("double"), "__ok": F.lit(False), "__k": F.lit(None).cast("int")}))
    reason = (F.when(F.col("beta").isNull(), "no hedge ratio").when(F.col("pvalue").isNull(), "no p-value")
              .when(F.col("half_life").isNull(), "no half-life").when(F.col("half_life") < min_half, "half-life too short to pay for its trades")
              .when(F.col("half_life") > max_half, "half-life longer than a position is held").otherwise(""))
    return out.withColumn("reason", reason).withColumn("passes", F.col("__ok") & (F.col("reason") == "")).drop("__ok", "__k")


def spread_pnl(walk: DataFrame, entry: float = 2.0, exit_: float = 0.5, cost_pct: float = 0.25) -> DataFrame:
    """Round trips on the z-score: in at ``entry``, out at ``exit_``.

    The state of a pair (flat, long or short since when) is a fold over its
    bars; it runs inside Spark on the pair's own ordered array.
    """
    item = F.struct("pos", "zscore", "py", "px", "beta")
    start = F.struct(F.lit(0).alias("side"), F.lit(0.0).alias("ey"), F.lit(0.0).alias("ex"), F.lit(0.0).alias("eb"),
                     F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(s, x):
        opens = (s["side"] == 0) & (F.abs(x["zscore"]) >= entry)
        closes = (s["side"] != 0) & (F.abs(x["zscore"]) <= exit_)
        notional = F.abs(s["ey"]) + F.abs(s["eb"] * s["ex"])
        gross = s["side"] * ((x["py"] - s["ey"]) - s["eb"] * (x["px"] - s["ex"]))
        won = 100.0 * gross / F.when(notional > 0, notional) - 2.0 * cost_pct
        return (F.when(opens, F.struct(F.when(x["zscore"] > 0, -1).otherwise(1).alias("side"), x["py"].alias("ey"), x["px"].alias("ex"),
                                       x["beta"].alias("eb"), s["total"].alias("total"), s["n"].alias("n")))
                .when(closes, F.struct(F.lit(0).alias("side"), s["ey"].alias("ey"), s["ex"].alias("ex"), s["eb"].alias("eb"),
                                       (s["total"] + F.coalesce(won, F.lit(0.0))).alias("total"),
                                       (s["n"] + F.when(won.isNotNull(), 1).otherwise(0)).alias("n")))
                .otherwise(s))

    g = walk.groupBy("y", "x").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return g.select("y", "x", F.aggregate("xs", start, step).alias("s")).select(
        "y", "x", F.col("s.n").alias("round_trips"), F.col("s.total").alias("total_pct"))


def in_sample(joint: DataFrame) -> DataFrame:
    """The same series with one hedge over the whole sample, for comparison."""
    w = Window.partitionBy("y", "x")
    b, a = F.regr_slope("py", "px").over(w), F.regr_intercept("py", "px").over(w)
    d = joint.withColumns({"beta": b, "__a": a}).withColumn("spread", F.col("py") - F.col("beta") * F.col("px") - F.col("__a"))
    z = (F.col("spread") - F.avg("spread").over(w)) / F.stddev_samp("spread").over(w)
    return d.withColumn("zscore", z).select("y", "x", "idx", "session", "pos", "py", "px", "beta", "spread", "zscore")
