"""Filings: as-of selection, comparable quarters, trailing year, valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import above, base_symbol, col, finite, ratio

# Calendar tolerances in days and the growth beyond which PEG means nothing.
YEAR, YEAR_TOL, STEP, STEP_TOL, MAX_GROWTH = 365, 45, 91, 35, 100.0
NATURES = ("consolidated", "standalone")


#: A date means the moment its session opens: what was disclosed later that day is not known yet.
MARKET_OPEN = "09:15:00"


def moment(as_of) -> Column:
    """A timestamp as it is, a date as its open."""
    text = str(as_of)
    return F.lit(f"{text} {MARKET_OPEN}" if len(text) == 10 else text).cast("timestamp")


def period_months(start="period_start", end="period_end") -> Column:
    """Length of a period in whole months, from its days: 3 a quarter, 9 and 12 the year to date."""
    return F.greatest(F.lit(1), F.round((F.datediff(col(end), col(start)) + 1) / 30.44).cast("int"))


def spanning(filings: DataFrame, months: int | None) -> DataFrame:
    """Periods of that length. Filings without ``period_start`` hold quarters only."""
    if months is None or "period_start" not in filings.columns:
        return filings
    return filings.where(period_months() == months)


def known_at(filings: DataFrame, as_of, months: int | None = None) -> DataFrame:
    return spanning(filings.where(F.col("disclosed_at") <= moment(as_of)), months)


def latest_filing(filings: DataFrame, as_of, months: int | None = None) -> DataFrame:
    """Newest filing per symbol disclosed by ``as_of``, as a partial aggregation.

    Without ``months`` any period counts, since a filing whose numbers are not
    read yet is still the latest; of one filing's periods the shortest is taken.
    """
    rest = [c for c in filings.columns if c != "symbol"]
    order = ["disclosed_at", "period_end", *(["period_start"] if "period_start" in rest else []), "nature"]
    return (known_at(filings, as_of, months).groupBy("symbol")
            .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("symbol", "r.*"))


def latest_as_of(asks: DataFrame, filings: DataFrame, value: str) -> DataFrame:
    """The value of the newest filing at the open of each distinct (symbol, as_of) date.

    Filings reduce to the last one per symbol and first day on which a date
    question can see it, questions to distinct days, so whatever share of the
    rows one symbol holds, its merged time order has at most two rows per day.
    The last filing is then carried forward.
    """
    ts = F.col("disclosed_at")
    opened = F.to_timestamp(F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(f" {MARKET_OPEN}")))
    seen_on = F.date_add(F.to_date(ts), F.when(ts > opened, 1).otherwise(0))
    f = (filings.groupBy("symbol", seen_on.alias("at")).agg(F.max(F.struct("disclosed_at", value)).alias("v"))
         .select("symbol", "at", F.lit(0).alias("k"), "v"))
    a = asks.select("symbol", F.col("as_of").cast("date").alias("at"), F.lit(1).alias("k")).distinct()
    a = a.withColumn("v", F.lit(None).cast(f.schema["v"].dataType))
    w = Window.partitionBy("symbol").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    out = f.unionByName(a).withColumn("n", F.last("v", ignorenulls=True).over(w)).where("k = 1")
    return out.select("symbol", F.col("at").alias("as_of"), F.col("n.disclosed_at").alias("disclosed_at"), F.col(f"n.{value}").alias(value))


def comparable(quarters: DataFrame) -> DataFrame:
    """Current quarter and its year-ago twin of the same nature, per symbol.

    Consolidated figures win when they have a twin, then standalone; without any
    twin the newest quarter of the preferred nature stands alone.
    """
    rank = F.when(F.col("nature") == NATURES[0], 0).otherwise(1)
    w = Window.partitionBy("symbol", "nature")
    q = spanning(quarters, 3).where(F.col("nature").isin(*NATURES) & F.col("period_end").isNotNull())
    q = q.withColumn("cur_end", F.max("period_end").over(w))
    off = F.abs(F.datediff("period_end", F.date_sub("cur_end", YEAR)))
    twin = (F.col("period_end") < F.col("cur_end")) & (off <= YEAR_TOL)
    rest = [c for c in quarters.columns if c not in ("symbol", "nature")]
    body = F.struct(*rest)
    g = q.groupBy("symbol", "nature").agg(F.max_by(body, F.when(F.col("period_end") == F.col("cur_end"), F.col("period_end"))).alias("current"),
                                          F.min_by(body, F.when(twin, F.col("period_end"))).alias("prior"))
    best = F.struct(F.when(F.col("prior").isNotNull(), 0).otherwise(1), rank)
    return g.groupBy("symbol").agg(F.min_by(F.struct("nature", "current", "prior"), best).alias("r")).select("symbol", "r.*")


def growth(now, before) -> Column:
    n, b = col(now), col(before)
    return F.when(b > 0, 100.0 * (n - b) / b)


def net_margin(pat, revenue) -> Column:
    return 100.0 * ratio(pat, revenue)


def derived(prefix: str = "") -> dict[str, Column]:
    """Ratios of one quarter; any missing input makes the result NULL."""
    c = lambda n: F.col(prefix + n)
    ebit = c("profit_before_tax") + c("finance_costs")
    rate = 100.0 * c("tax_expense") / above(c("profit_before_tax"))
    return {"shares_outstanding": finite(above(c("paid_up_capital")) / above(c("face_value"))), "ebit": finite(ebit),
            "ebitda": finite(ebit + c("depreciation")), "effective_tax_rate_pct": finite(rate), "nopat": finite(ebit * (1 - rate / 100.0)),
            "op_margin_pct": finite(100.0 * ebit / above(c("revenue"))), "interest_cover": finite(ebit / above(c("finance_costs")))}


def build_table(filings: DataFrame, as_of, sectors: DataFrame | None = None) -> DataFrame:
    """Growth, margin change, filing age and derived ratios per symbol, from its quarters.

    ``industry`` comes from ``sectors`` (symbol, industry) and is null without it.
    """
    q = known_at(filings, as_of, 3)
    newest = q.groupBy("symbol").agg(F.max("disclosed_at").alias("last_disclosed"))
    t = comparable(q).join(newest, "symbol")
    now, was = (lambda n: F.col(f"current.{n}")), (lambda n: F.col(f"prior.{n}"))
    m1, m0 = net_margin(now("profit_after_tax"), now("revenue")), net_margin(was("profit_after_tax"), was("revenue"))
    if sectors is not None:
        named = sectors.groupBy(base_symbol("symbol").alias("__b")).agg(F.min("industry").alias("industry"))
        t = t.join(named, base_symbol("symbol") == F.col("__b"), "left")
    else:
        t = t.withColumn("industry", F.lit(None).cast("string"))
    return t.select("symbol", "industry", "nature", now("period_end").alias("period_end"), now("revenue").alias("revenue"),
                    now("profit_after_tax").alias("profit_after_tax"), m1.alias("net_margin_pct"),
                    growth(now("revenue"), was("revenue")).alias("revenue_growth_yoy_pct"),
                    growth(now("profit_after_tax"), was("profit_after_tax")).alias("profit_growth_yoy_pct"),
                    (m1 - m0).alias("margin_change_pp"),
                    F.datediff(F.lit(as_of).cast("date"), F.to_date("last_disclosed")).alias("days_since_filing"),
                    F.when(F.col("prior").isNull(), "no year-ago comparison").otherwise("complete").alias("coverage"),
                    *[v.alias(k) for k, v in derived("current.").items()])


def coverage_reasons(asked: DataFrame, filings: DataFrame, as_of, table: DataFrame | None = None) -> DataFrame:
    """(base, reason) of every asked symbol: complete, or the first thing that is missing.

    A symbol with a stored body that could not be read (``unreadable``, where the
    filings have it) is told apart from one without filings, and one whose
    quarters have no nature or end from one without a year-ago quarter.
    """
    known = filings.where(F.col("disclosed_at") <= moment(as_of))
    broken = F.max(F.coalesce("unreadable", F.lit(False))) if "unreadable" in filings.columns else F.lit(False)
    length = period_months() if "period_start" in filings.columns else F.lit(3)
    held = known.groupBy(base_symbol("symbol").alias("base")).agg(broken.alias("broken"), F.max((length == 3).cast("int")).alias("quarters"))
    t = (build_table(filings, as_of) if table is None else table).select(base_symbol("symbol").alias("base"), "coverage")
    a = asked.select(base_symbol("symbol").alias("base")).join(held, "base", "left").join(t, "base", "left")
    return a.select("base", F.when(F.col("broken"), "unreadable").when(F.coalesce("quarters", F.lit(0)) == 0, "no filings on file")
                    .when(F.col("coverage").isNull(), "no quarterly numbers").otherwise(F.col("coverage")).alias("reason"))


def coverage_counts(asked: DataFrame, filings: DataFrame, as_of) -> DataFrame:
    """Exclusive reason per asked symbol, counted."""
    return coverage_reasons(asked, filings, as_of).groupBy("reason").agg(F.count(F.lit(1)).alias("symbols"))


def trailing_twelve(quarters: DataFrame) -> DataFrame:
    """Sums of the last four quarters of one nature when they step about 91 days.

    A missing figure in any of the four makes its sum NULL.
    """
    w = Window.partitionBy("symbol", "nature").orderBy(F.desc("period_end"))
    q = spanning(quarters, 3).where(F.col("nature").isin(*NATURES)).withColumns(
        {"k": F.row_number().over(w), "step": F.datediff(F.lag("period_end").over(w), "period_end")}).where("k <= 4")
    total = lambda c: F.when(F.count(c) == 4, F.sum(c))
    g = q.groupBy("symbol", "nature").agg(
        F.count(F.lit(1)).alias("quarters"), F.max("period_end").alias("period_end"),
        F.max(F.abs(F.col("step") - STEP)).alias("drift"), total("revenue").alias("revenue_ttm"),
        total("profit_after_tax").alias("pat_ttm"), total("eps_basic").alias("eps_ttm"),
        F.max_by(F.struct("paid_up_capital", "face_value"), "period_end").alias("cap"))
    ok = g.where((F.col("quarters") == 4) & (F.col("drift") <= STEP_TOL)).withColumn(
        "shares_outstanding", F.col("cap.paid_up_capital") / above("cap.face_value")).drop("drift", "cap")
    rank = F.when(F.col("nature") == NATURES[0], 0).otherwise(1)
    rest = [c for c in ok.columns if c != "symbol"]
    return ok.groupBy("symbol").agg(F.min_by(F.struct(*rest), rank).alias("r")).select("symbol", "r.*")


def valuation(ttm: DataFrame, closes: DataFrame, suspect: DataFrame, as_of) -> DataFrame:
    """Market value and multiples; a suspect share count gives no market value."""
    d = (ttm.join(closes.select("symbol", "close").where("close > 0"), "symbol")
         .join(suspect.select("symbol", F.lit(True).alias("hit")).distinct(), "symbol", "left"))
    flag = F.coalesce("hit", F.lit(False))
    mcap = F.when(~flag & (F.col("shares_outstanding") != 0), F.col("shares_outstanding") * F.col("close"))
    d = d.withColumns({"share_count_suspect": flag, "market_cap": mcap,
                       "earnings_age_days": F.datediff(F.lit(as_of).cast("date"), "period_end")})
    m = F.col("market_cap")
    return d.withColumns({"pe_ttm": m / above("pat_ttm"), "earnings_yield_pct": 100.0 * F.col("pat_ttm") / F.nullif(m, F.lit(0.0)),
                          "ps_ttm": m / above("revenue_ttm")}).drop("hit")


def peg(pe="pe_ttm", growth_pct="profit_growth_yoy_pct", limit: float = MAX_GROWTH) -> Column:
    g = col(growth_pct)
    return F.when((g > 0) & (g <= limit), above(pe) / g)


def newest_build(tables: DataFrame, as_of, key: str = "as_of", stale_after: int = 5) -> DataFrame:
    """Rows of the newest stored build not after ``as_of``, with its age."""
    day = F.lit(as_of).cast("date")
    pick = tables.where(F.col(key) <= day).agg(F.max(key)).scalar()
    age = F.datediff(day, F.col(key))
    return tables.where(F.col(key) == pick).withColumns({"age_days": age, "stale": age > stale_after})
