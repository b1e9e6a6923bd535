"""Option chains: tradeable splits, coherence, vertical spreads held to expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Entry window in days, reward-to-risk band, open-interest floor, tick of slack.
DTE, RR_LOW, RR_HIGH, RR_IDEAL, MIN_OI, SLACK = (21, 35), 1.65, 2.35, 2.0, 500.0, 0.05


def options_of(contracts: DataFrame) -> DataFrame:
    return contracts.where(F.col("option_type").isin("CE", "PE"))


def futures_of(contracts: DataFrame) -> DataFrame:
    return contracts.where(F.col("option_type").isNull())


def chain(contracts: DataFrame, symbol: str, expiry) -> DataFrame:
    return (options_of(contracts).where((F.col("symbol") == symbol) & (F.col("expiry") == F.lit(expiry).cast("date")))
            .orderBy("strike", "option_type"))


def dte(expiry="expiry", trade_date="trade_date") -> Column:
    return F.datediff(expiry, trade_date)


def intrinsic() -> Column:
    call = F.greatest(F.col("underlying") - F.col("strike"), F.lit(0.0))
    put = F.greatest(F.col("strike") - F.col("underlying"), F.lit(0.0))
    return F.when(F.col("option_type") == "CE", call).otherwise(put)


def coherence(contracts: DataFrame, tol: float = SLACK, keys=()) -> DataFrame:
    """Share of calls under intrinsic, and of neighbours whose price rises with strike."""
    c = contracts.where("option_type = 'CE' AND strike IS NOT NULL AND close IS NOT NULL AND underlying IS NOT NULL")
    w = Window.partitionBy(*keys, "symbol", "expiry").orderBy("strike")
    c = c.withColumn("step", F.col("close") - F.lag("close").over(w))
    return c.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"),
                                F.avg((F.col("close") < intrinsic() - tol).cast("double")).alias("below_intrinsic"),
                                F.avg((F.col("step") > tol).cast("double")).alias("non_monotonic"))


def spreads(contracts: DataFrame, days=DTE, min_oi: float = MIN_OI, keys=("trade_date", "symbol", "expiry", "option_type")) -> DataFrame:
    """Per chain the vertical spread whose reward-to-risk is nearest two.

    With net premium p and width w the ratio (w - p) / p lies in the band only if
    w is within 0.35 p of 3 p, that is if ``strike +- 3 price`` of the two legs
    differ by at most 0.35 p. Legs are therefore bucketed on that quantity, each
    bucket as wide as the chain's largest possible difference, and only legs of
    equal or neighbouring buckets meet - not every pair of strikes.
    """
    keys = list(keys)
    o = contracts.where((F.col("open_interest") >= min_oi) & (F.col("volume") > 0) & F.col("strike").isNotNull()
                        & F.col("close").isNotNull() & (F.col("underlying") > 0) & (F.col("lot_size") > 0) & dte().between(*days))
    w = Window.partitionBy(*keys)
    o = o.withColumn("__n", F.count(F.lit(1)).over(w)).where("__n >= 3").where(F.col("close") >= intrinsic() - SLACK)
    sign = F.when(F.col("option_type") == "CE", 1.0).otherwise(-1.0)
    o = o.withColumns({"__g": F.col("strike") + sign * (RR_IDEAL + 1) * F.col("close"), "__p": F.max("close").over(w)})
    span = max(RR_IDEAL - RR_LOW, RR_HIGH - RR_IDEAL) + 1e-9
    o = o.withColumn("__b", F.floor(F.col("__g") / F.greatest(F.col("__p") * span, F.lit(1e-9))))
    lo = o.select(*keys, "__b", F.col("strike").alias("k1"), F.col("close").alias("p1"), "underlying", "lot_size")
    hi = o.select(*keys, F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)).alias("__b"),
                  F.col("strike").alias("k2"), F.col("close").alias("p2"))
    prem = F.when(F.col("option_type") == "CE", F.col("p1") - F.col("p2")).otherwise(F.col("p2") - F.col("p1"))
    s = lo.join(hi, keys + ["__b"]).where("k1 < k2").withColumns({"premium": prem, "width": F.col("k2") - F.col("k1")})
    s = s.where((F.col("premium") > 0) & (F.col("premium") < F.col("width")))
    s = s.withColumn("rr", (F.col("width") - F.col("premium")) / F.col("premium")).where(F.col("rr").between(RR_LOW, RR_HIGH))
    body = F.struct("k1", "k2", "premium", "width", "rr", "underlying", "lot_size")
    return (s.groupBy(*keys).agg(F.min_by(body, F.struct(F.abs(F.col("rr") - RR_IDEAL), "k1", "k2")).alias("b"))
            .select(*keys, "b.*").withColumn("outlay", F.col("premium") * F.col("lot_size")))


def settle(spread: DataFrame, prices: DataFrame) -> DataFrame:
    """Payoff at expiry against the underlying's price of that session."""
    s = spread.join(prices.select("symbol", F.col("session").alias("expiry"), F.col("close").alias("settle")), ["symbol", "expiry"])
    move = F.when(F.col("option_type") == "CE", F.col("settle") - F.col("k1")).otherwise(F.col("k2") - F.col("settle"))
    pay = F.least(F.greatest(move, F.lit(0.0)), F.col("width")) - F.col("premium")
    return s.withColumn("payoff", pay).withColumns({"r": F.col("payoff") / F.col("premium"), "cost_r": fees() / F.col("outlay")})


# Flat brokerage per order, tax on it, statutory percent of the outlay.
BROKERAGE, GST_PCT, STT_PCT, EXCH_PCT = 20.0, 18.0, 0.15, 0.03503


def fees() -> Column:
    return 2 * BROKERAGE * (1 + GST_PCT / 100) * 2 + F.col("outlay") * (STT_PCT + EXCH_PCT) / 100


def report(trades: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Overlapping subgroups in one pass: a trade is tagged with every group it is in."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()]))
    t = trades.withColumn("grp", F.explode(tags))
    full = F.when(F.col("option_type") == "CE", F.col("settle") >= F.col("k2")).otherwise(F.col("settle") <= F.col("k1"))
    return t.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("gross_r"), F.avg("cost_r").alias("cost_r"), (F.avg("r") - F.avg("cost_r")).alias("net_r"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.avg(full.cast("double")).alias("max_profit_rate"),
        (F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * F.sqrt(F.count("r"))).alias("t_stat"))


def expiry_test(trades: DataFrame, min_trades: int = 30) -> DataFrame:
    """One observation per expiry, then its t-statistic and the OLS on the move."""
    e = trades.groupBy("expiry").agg(F.avg("r").alias("mean_r"), F.count(F.lit(1)).alias("n"), F.avg("move_pct").alias("move")).where(F.col("n") >= min_trades)
    g = e.agg(F.count(F.lit(1)).alias("expiries"), F.avg("mean_r").alias("mean_r"), F.stddev_samp("mean_r").alias("sd"),
              F.regr_slope("mean_r", "move").alias("slope"), F.regr_intercept("mean_r", "move").alias("alpha"), F.regr_r2("mean_r", "move").alias("r2"),
              F.regr_sxx("mean_r", "move").alias("sxx"), F.regr_syy("mean_r", "move").alias("syy"), F.avg("move").alias("mx"))
    n = F.col("expiries")
    s2 = F.col("syy") * (1 - F.col("r2")) / F.when(n > 2, n - 2)
    se = F.sqrt(s2 * (1.0 / n + F.col("mx") * F.col("mx") / F.nullif(F.col("sxx"), F.lit(0.0))))
    return g.select("expiries", "mean_r", (F.col("mean_r") / F.nullif(F.col("sd"), F.lit(0.0)) * F.sqrt(n)).alias("t_stat"), "slope", "alpha", "r2",
                    (F.col("alpha") / F.nullif(se, F.lit(0.0))).alias("alpha_t"))
