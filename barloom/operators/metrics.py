"""Result measures of simulated trades and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import frames as W
from ..functions.selection import with_quantiles, with_stretch
from ..session import cut_lineage
from .costs import CostModel


def with_costs(trades: DataFrame, model: CostModel = CostModel()) -> DataFrame:
    cost = model.round_trip("entry_price", "exit_price", "qty")
    risk = F.abs(F.col("entry_price") - F.col("stop")) * F.col("qty")
    return trades.withColumns({"cost": cost, "cost_r": cost / F.when(risk > 0, risk)}).withColumns(
        {"net_pnl": F.col("gross_pnl") - F.col("cost"), "net_r": F.col("r_multiple") - F.col("cost_r")})


def summary(trades: DataFrame, keys=()) -> DataFrame:
    """Counts, win rate, expectancy gross and net, P&L. One partial aggregation."""
    r = F.col("r_multiple")
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(r > 0).alias("wins"),
        (100.0 * F.try_divide(F.count_if(r > 0), F.count(r))).alias("win_rate"), F.avg(r).alias("expectancy_r"),
        F.avg("net_r").alias("expectancy_r_net"), F.sum(r).alias("total_r"),
        F.sum("gross_pnl").alias("gross_pnl"), F.sum("cost").alias("total_costs"), F.sum("net_pnl").alias("net_pnl"),
        F.count_if("ambiguous").alias("ambiguous"), F.count_if("gapped").alias("gapped"))


def by_exit(trades: DataFrame, keys=()) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(F.count(F.lit(1)).alias("trades"), F.avg("r_multiple").alias("mean_r"))


def max_drawdown_r(trades: DataFrame, session: str = "exit_date", r: str = "r_multiple", tie=("symbol", "sid")) -> DataFrame:
    """Deepest fall of the running R sum from its high, the high starting at 0.

    Trades stand by session, then ``tie``. A stretch of them is summed up by its
    total and its highest running sum, and summaries of neighbours combine, so
    stretches are taken one by one: value ranges of the first tie column inside a
    session. A session with most of the trades is as many stretches as others.
    """
    t = with_stretch(cut_lineage(trades.where(F.col(r).isNotNull()).select(session, *tie, r)), tie[0])
    unit = [session, "__stretch"]
    w = Window.partitionBy(*unit).orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("__run", F.sum(r).over(w))
    t = t.withColumn("__top", F.max("__run").over(w))
    part = t.groupBy(*unit).agg(F.sum(r).alias("__sum"), F.max("__run").alias("__max"))
    past = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)  # at most 65 rows a session
    part = part.withColumn("__off", F.coalesce(F.sum("__sum").over(past), F.lit(0.0)))
    part = part.withColumn("__high", F.greatest(F.lit(0.0), F.coalesce(
        F.max(F.col("__off") + F.col("__max")).over(past), F.lit(0.0))))
    return (t.join(part.select(*unit, "__off", "__high"), unit)
            .agg(F.least(F.lit(0.0), F.min(F.col("__off") + F.col("__run") - F.greatest(
                F.col("__high"), F.col("__off") + F.col("__top")))).alias("max_drawdown_r")))


def linspace_windows(n: Column, windows: int) -> Column:
    """Array of (window, lo, hi) positions splitting 0..n evenly."""
    return F.array(*[F.struct(F.lit(i).alias("window"), F.floor(n * i / windows).alias("lo"),
                              F.floor(n * (i + 1) / windows).alias("hi")) for i in range(windows)])


def cohort_summary(trades: DataFrame, keys, month: str, rr: float, cost_r: float, min_trades: int = 30) -> DataFrame:
    """Per window: net R as mean of monthly means, median, share at target."""
    t = cut_lineage(trades.select(*keys, month, "r").withColumn("net", F.col("r") - cost_r))
    cohort = t.groupBy(*keys, month).agg(F.avg("net").alias("m"))
    net = cohort.groupBy(*keys).agg(F.avg("m").alias("net_r"))
    flat = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"),
                                (100.0 * F.avg((F.abs(F.col("r") - rr) < 1e-9).cast("double"))).alias("target_hit_pct"))
    out = with_quantiles(flat.join(net, list(keys)), t, keys, "net", {"median_net_r": 0.5})
    scored = F.col("trades") >= min_trades
    return out.withColumns({"scored": scored, "positive": scored & (F.col("net_r") > 0)})


def pooled_verdict(windows: DataFrame, keys=()) -> DataFrame:
    s = F.col("scored")
    g = windows.groupBy(*keys).agg(F.count_if(s).alias("scored"), F.count_if("positive").alias("windows_positive"),
                                   F.avg(F.when(s, F.col("net_r"))).alias("pooled_net_r"))
    return g.withColumn("verdict", F.when(F.col("scored") == 0, "sample too small")
                        .when((F.col("pooled_net_r") > 0) & (F.col("windows_positive") == F.col("scored"))
                              & (F.col("scored") >= 3), "positive in every window")
                        .when(F.col("pooled_net_r") > 0, "positive in part").otherwise("no case"))


def baseline_summary(trials: DataFrame, strategy: Column, value: str = "expectancy_r") -> DataFrame:
    """Where a strategy's expectancy falls among random trials."""
    v = F.col(value)
    return trials.agg(F.count(v).alias("trials"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
                      F.min(v).alias("lowest"), F.max(v).alias("highest"),
                      (100.0 * F.avg((v < strategy).cast("double"))).alias("percentile"))


# ---- position series -----------------------------------------------------

def product_over(x: Column, over=None) -> Column:
    """Product of factors of any sign, as an aggregate or over a window."""
    def agg(c):
        return c if over is None else c.over(over)
    size = F.exp(agg(F.sum(F.when(x != 0, F.log(F.abs(x))))))
    flips = agg(F.sum(F.when(x < 0, 1).otherwise(0)))
    zero = agg(F.max(F.when(x == 0, 1).otherwise(0)))
    return F.when(zero == 1, 0.0).otherwise(F.coalesce(size, F.lit(1.0)) * F.when(flips % 2 == 1, -1.0).otherwise(1.0))

def backtest_positions(df: DataFrame, cost_pct: float = 0.05) -> DataFrame:
    """Strategy return of a position held from the previous row, less turnover."""
    ret = F.coalesce(F.col("close") / F.lag("close").over(W.ordered()) - 1.0, F.lit(0.0))
    held = F.coalesce(F.lag("position").over(W.ordered()), F.lit(0))
    turn = F.coalesce(F.abs(F.col("position") - F.lag("position").over(W.ordered())), F.abs("position"))
    df = df.withColumns({"daily_return": ret, "held": held, "turnover_units": turn})
    df = df.withColumn("strategy_return", F.col("held") * F.col("daily_return") - F.col("turnover_units") * cost_pct / 100.0)
    return df.withColumns({"equity": product_over(1.0 + F.col("strategy_return"), W.so_far()),
                           "buy_hold": product_over(1.0 + F.col("daily_return"), W.so_far())})


def position_trades(df: DataFrame) -> DataFrame:
    """Runs of an unchanged non-zero position; the return excludes the entry row
    and includes the row on which the run ends."""
    w = W.ordered()
    change = F.coalesce((F.col("position") != F.lag("position").over(w)).cast("int"), F.lit(1))
    n = df.withColumns({"__run": F.sum(change).over(W.so_far()), "__row": F.row_number().over(w),
                        "__next": F.lead("strategy_return").over(w), "__nextday": F.lead("session").over(w)})
    # each row lends the return of the row after it: rows entry..exit-1 give entry+1..exit
    g = (n.where("position != 0").groupBy("symbol", "__run").agg(
        F.min("session").alias("entry_date"), F.coalesce(F.max_by("__nextday", "__row"), F.max("session")).alias("exit_date"),
        F.first("position").alias("direction"), product_over(1.0 + F.coalesce("__next", F.lit(0.0))).alias("__g"),
        F.max("__row").alias("__l"), F.min("__row").alias("__f"),
        F.max_by(F.col("__nextday").isNull(), "__row").alias("still_open")))
    held = F.col("__l") - F.col("__f") + F.when(F.col("still_open"), 0).otherwise(1)
    return g.select("symbol", "entry_date", "exit_date", "direction", held.alias("bars_held"),
                    (100.0 * (F.col("__g") - 1.0)).alias("trade_return_pct"), "still_open")


def position_metrics(df: DataFrame) -> DataFrame:
    """Return, risk and drawdown measures per symbol of a position series."""
    peak = F.max("equity").over(W.so_far())
    r = F.col("strategy_return")
    d = df.withColumn("__dd", F.col("equity") / peak - 1.0)
    g = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min_by("equity", "idx").alias("__e0"), F.max_by("equity", "idx").alias("__e1"),
        F.avg(r).alias("__m"), F.stddev_samp(r).alias("__s"), F.stddev_samp(F.when(r < 0, r)).alias("__ds"),
        (100.0 * F.min("__dd")).alias("max_drawdown_pct"),
        (100.0 * F.avg((F.col("position") != 0).cast("double"))).alias("exposure_pct"))
    years, growth = F.col("bars") / 252.0, F.col("__e1") / F.col("__e0")
    return g.select("symbol", "bars", (100.0 * (growth - 1)).alias("total_return_pct"),
                    (100.0 * (F.pow(F.when(growth > 0, growth), 1.0 / years) - 1)).alias("cagr_pct"),
                    (F.col("__m") / F.when(F.col("__s") > 0, F.col("__s")) * F.sqrt(F.lit(252.0))).alias("sharpe"),
                    (F.col("__m") / F.when(F.col("__ds") > 0, F.col("__ds")) * F.sqrt(F.lit(252.0))).alias("sortino"),
                    "max_drawdown_pct", (100.0 * F.col("__s") * F.sqrt(F.lit(252.0))).alias("volatility_pct"), "exposure_pct")


def trade_metrics(trades: DataFrame) -> DataFrame:
    """Win/loss measures per symbol over closed trades, with the worst streak."""
    t = trades.where(~F.col("still_open"))
    r = F.col("trade_return_pct")
    w = Window.partitionBy("symbol").orderBy("entry_date")
    wins_before = F.sum((r > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    streak = (t.withColumn("__island", wins_before).where(r <= 0).groupBy("symbol", "__island")
              .agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(F.max("n").alias("max_losses_in_row")))
    g = t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("closed_trades"), (100.0 * F.try_divide(F.count_if(r > 0), F.count(r))).alias("win_rate_pct"),
        F.avg(r).alias("avg_trade_pct"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win_pct"),
        F.coalesce(F.avg(F.when(r <= 0, r)), F.lit(0.0)).alias("avg_loss_pct"),
        (F.sum(F.when(r > 0, r)) / F.nullif(-F.sum(F.when(r <= 0, r)), F.lit(0.0))).alias("profit_factor"),
        F.avg("bars_held").alias("avg_bars_held"))
    p = F.col("win_rate_pct") / 100.0
    return (g.join(streak, "symbol", "left")
            .withColumns({"max_losses_in_row": F.coalesce("max_losses_in_row", F.lit(0)),
                          "expectancy_pct": p * F.col("avg_win_pct") + (1 - p) * F.col("avg_loss_pct"),
                          "payoff_ratio": F.abs(F.col("avg_win_pct") / F.when(F.col("avg_loss_pct") < 0, F.col("avg_loss_pct")))}))
