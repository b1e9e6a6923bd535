"""Bindings: market-panel views derived from the given tables.

Prices are ``l_extendedprice / l_quantity``. A bar is reduced from line items by
one partial aggregation on (symbol, session): whatever share of the rows one
symbol holds, each map task ships at most one row per bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.panel import index_sessions


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _place(lines: DataFrame) -> Column:
    """Order of a line inside its session as one decimal number: day, order, line, part, supplier, nulls last.

    A number of fixed width keeps the aggregation buffer fixed too, so bars are
    hash aggregated and no raw row is sorted. Keys count from their smallest in
    ``lines``, so the number is exact as long as the ranges of the keys fit 38
    digits together. Beyond that its digits hold the day of a session of up to
    998 days, any order key and any line number, and five digits of the part key.
    """
    keys = {"o": "l_orderkey", "l": "l_linenumber", "p": "l_partkey", "s": "l_suppkey"}
    ends = lines.agg(*[f(c).cast("long").alias(k + e) for k, c in keys.items() for e, f in (("0", F.min), ("1", F.max))])
    wide = lambda k: F.coalesce(F.col(k + "1").cast("double") - F.col(k + "0").cast("double"), F.lit(0.0)) + 2
    tail = wide("l") * wide("p") * wide("s")
    fits = (wide("o") < 9e15) & (tail < 9e15) & (1000 * wide("o") * tail < 1e37)
    number = lambda k: F.when(F.col("fits"), wide(k).cast("long"))
    ends = ends.withColumns({"fits": fits, "tail": F.when(fits, tail.cast("long")).cast("decimal(16,0)")})
    known = ends.select(F.struct("fits", "tail", *[k + "0" for k in keys], *[number(k).alias("n" + k) for k in keys]).alias("e")).scalar()
    day = F.least(F.coalesce(F.datediff("l_shipdate", "session"), F.lit(999)), F.lit(999))
    at = lambda k: F.coalesce(F.col(keys[k]).cast("long") - known[k + "0"], known["n" + k] - 1)
    head = (day * known["no"] + at("o")).cast("decimal(20,0)")
    rest = ((at("l") * known["np"] + at("p")) * known["ns"] + at("s")).cast("decimal(16,0)")
    return F.when(known["fits"], (head * known["tail"] + rest).cast("decimal(38,0)")).otherwise(_place_of_wide_keys())


def _place_of_wide_keys() -> Column:
    whole = lambda n, digits: F.lit(str(n)).cast(f"decimal({digits},0)")
    day = F.least(F.coalesce(F.datediff("l_shipdate", "session"), F.lit(999)), F.lit(999)).cast("decimal(3,0)")
    order = F.coalesce((F.col("l_orderkey").cast("decimal(20,0)") + whole(2 ** 63, 20)).cast("decimal(20,0)"), whole(10 ** 20 - 1, 20))
    line = F.greatest(F.least(F.col("l_linenumber").cast("long"), F.lit(7 * 10 ** 9)), F.lit(-2 ** 31)) + 2 ** 31
    line = F.when(F.col("l_linenumber").isNull(), F.lit(10 ** 10 - 1)).otherwise(line)
    part = F.coalesce(F.pmod("l_partkey", F.lit(99_999)).cast("long"), F.lit(99_999))
    head = day * whole(10 ** 20, 21) + order
    return (head * whole(10 ** 15, 16) + (line * 100_000 + part).cast("decimal(15,0)")).cast("decimal(38,0)")


def _bars(rows: DataFrame, keys: list[str], lines: DataFrame) -> DataFrame:
    price, at = F.col("l_extendedprice") / F.col("l_quantity"), F.col("__at")
    return rows.withColumn("__at", _place(lines)).groupBy(*keys).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, at).alias("close"), F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("turnover"), F.count(F.lit(1)).alias("trades"))


def _line(spark, sf, grain: str) -> DataFrame:
    return (table(spark, sf, "lineitem")
            .withColumn("session", F.to_date(F.date_trunc(grain, "l_shipdate"))))


def sessions(spark, sf, grain: str) -> DataFrame:
    """Distinct sessions straight from the one date column."""
    return _line(spark, sf, grain).select("session").distinct()


def bars(spark, sf, grain: str = "month", index: bool = True) -> DataFrame:
    """Supplier bars: many symbols, a few gaps."""
    rows = _line(spark, sf, grain).withColumn("symbol", F.concat(F.lit("S"), "l_suppkey"))
    out = _bars(rows, ["symbol", "session"], table(spark, sf, "lineitem"))
    return index_sessions(out, sessions(spark, sf, grain)) if index else out


def brand_bars(spark, sf, grain: str = "month", index: bool = True) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    rows = _line(spark, sf, grain).join(part, F.col("l_partkey") == F.col("p_partkey"))
    out = _bars(rows, ["symbol", "session"], table(spark, sf, "lineitem"))
    return index_sessions(out, sessions(spark, sf, grain)) if index else out


def calm_bars(spark, sf, index: bool = True) -> DataFrame:
    """Monthly brand bars whose prices are weekly volume-weighted averages."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    rows = _line(spark, sf, "week").join(part, F.col("l_partkey") == F.col("p_partkey"))
    weeks = rows.groupBy("symbol", F.col("session").alias("wk")).agg(
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover"),
        F.count(F.lit(1)).alias("trades"))
    weeks = weeks.withColumns({"price": F.col("turnover") / F.col("volume"),
                               "session": F.to_date(F.date_trunc("month", "wk"))})
    out = weeks.groupBy("symbol", "session").agg(
        F.min_by("price", "wk").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "wk").alias("close"), F.sum("volume").alias("volume"),
        F.sum("turnover").alias("turnover"), F.sum("trades").alias("trades"))
    months = sessions(spark, sf, "week").select(F.to_date(F.date_trunc("month", "session")).alias("session")).distinct()
    return index_sessions(out, months) if index else out


def vwap_weeks(spark, sf) -> DataFrame:
    """Weekly brand panel whose close is the volume-weighted average price."""
    b = brand_bars(spark, sf, "week")
    return b.select("symbol", "session", "idx", (F.col("turnover") / F.col("volume")).alias("close"),
                    "high", "low", "volume", "turnover", "trades")


def series_bars(spark, sf, grain: str = "month") -> DataFrame:
    """Supplier bars split by return flag: duplicate (session, symbol) keys."""
    rows = _line(spark, sf, grain).withColumns(
        {"symbol": F.concat(F.lit("S"), "l_suppkey"), "series": F.col("l_returnflag")})
    return _bars(rows, ["symbol", "session", "series"], table(spark, sf, "lineitem"))


def sourced_bars(spark, sf, status: str, grain: str = "quarter") -> DataFrame:
    """The same symbols seen by one of two sources (line status)."""
    rows = (_line(spark, sf, grain).where(F.col("l_linestatus") == status)
            .withColumn("symbol", F.concat(F.lit("S"), "l_suppkey")))
    return _bars(rows, ["symbol", "session"], table(spark, sf, "lineitem"))


def hour_bars(spark, sf) -> DataFrame:
    """Intraday bars: event type as symbol, day as session, hour as bar."""
    ev = table(spark, sf, "events").withColumns(
        {"symbol": F.col("event_type"), "session": F.to_date("ts"),
         "bar_ts": F.date_trunc("hour", "ts")})
    at = F.struct("ts", "event_id")
    return ev.groupBy("symbol", "session", "bar_ts").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"))


def industries(spark, sf) -> DataFrame:
    """Supplier symbol to region name, the sector map."""
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
            .join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"),
                    F.col("r_name").alias("industry"), F.col("n_name").alias("nation")))


def filings(spark, sf, year_to_date: bool = False) -> DataFrame:
    """Quarterly figures per customer nation, disclosed thirty days after the quarter.

    With ``year_to_date`` each filing from the second quarter on also holds the
    figures since the year began, as periods of 6, 9 and 12 months.
    """
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    q = (o.join(c, o.o_custkey == c.c_custkey)
         .withColumns({"symbol": F.concat(F.lit("N"), "c_nationkey"),
                       "period_start": F.to_date(F.date_trunc("quarter", "o_orderdate")),
                       "nature": F.when(F.col("o_orderstatus") == "F", "consolidated")
                       .when(F.col("o_orderstatus") == "O", "standalone").otherwise("unknown")}))
    g = q.groupBy("symbol", "period_start", "nature").agg(
        F.sum("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice") * (F.col("o_orderkey") % 7 - 2) / 50).alias("profit_after_tax"))
    g = g.withColumn("next", F.add_months("period_start", 3))
    if year_to_date:
        so_far = Window.partitionBy("symbol", "nature", F.year("period_start")).orderBy("period_start").rowsBetween(Window.unboundedPreceding, 0)
        g = g.unionByName(g.withColumns({c: F.sum(c).over(so_far) for c in ("revenue", "n", "profit_after_tax")})
                          .where(F.month("period_start") > 1).withColumn("period_start", F.to_date(F.date_trunc("year", "period_start"))))
    end = F.date_sub("next", 1)
    pat, rev = F.col("profit_after_tax"), F.col("revenue")
    return g.withColumns({
        "period_end": end, "disclosed_at": F.expr("cast(date_add(next, 29) as timestamp) + interval 12 hours"),
        "eps_basic": pat / 1e6, "paid_up_capital": F.col("n") * 1e5, "face_value": F.when(F.col("n") % 11 != 0, 10.0),
        "profit_before_tax": pat * 1.3, "finance_costs": rev * 0.02, "depreciation": rev * 0.03, "tax_expense": pat * 0.3}).drop("next")


def contracts(spark, sf) -> DataFrame:
    """An option chain per shipped line: brand as underlying, one fixed spot.

    Strikes are rounded quantities around the spot, the premium falls with the
    strike and carries the line's own noise.
    """
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"), "p_retailprice")
    li = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    day = F.to_date(F.date_trunc("month", "l_shipdate"))
    d = li.select("symbol", day.alias("trade_date"), F.date_add(day, 28).alias("expiry"), F.col("l_linenumber").alias("ln"),
                  F.when(F.col("l_orderkey") % 2 == 0, "CE").otherwise("PE").alias("option_type"),
                  (900.0 + F.floor(F.col("l_quantity") / 2) * 10).alias("strike"), "l_discount", "l_quantity", "l_extendedprice")
    g = d.groupBy("symbol", "trade_date", "expiry", "option_type", "strike").agg(
        F.max("l_discount").alias("dc"), F.count(F.lit(1)).alias("k"), F.sum("l_quantity").alias("q"))
    spot = F.lit(1020.0)
    away = F.when(F.col("option_type") == "CE", spot - F.col("strike")).otherwise(F.col("strike") - spot)
    return g.withColumns({"underlying": spot, "close": F.greatest(away, F.lit(0.0)) * 0.6 + 45.0 + away * 0.25 + F.col("dc") * 60,
                          "volume": F.col("q"), "open_interest": F.col("q") * 20, "lot_size": F.lit(25.0)})
