"""Data-quality gates over a whole panel: one row per symbol and failed check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import frames as W
from ..functions.scalars import truth
from .panel import EQUITY_SERIES

# Check limits and the ratios a split or bonus usually has.
STALE_RUN = 5
MOVE_LIMIT_PCT = 20.0
ZERO_VOLUME_FATAL_PCT = 20.0
COMMON_RATIOS = ((1.5, "1:2 bonus"), (2.0, "1:1 bonus or 1-for-2 split"), (2.5, "3:2 bonus"),
                 (3.0, "2:1 bonus or 1-for-3 split"), (4.0, "3:1 bonus or 1-for-4 split"),
                 (5.0, "1-for-5 split"), (10.0, "1-for-10 split"))


class QualityError(ValueError):
    """A panel with a fatal issue was about to be used."""


def stage0(day: DataFrame, min_price: float = 20.0, min_turnover: float = 100.0,
           drop_locked: bool = False, series=EQUITY_SERIES, turnover: str = "turnover_lacs") -> DataFrame:
    """Each row with the first exclusion that removes it; NULL marks a survivor."""
    locked = (F.col("high") == F.col("low")) & (F.col("volume") > 0)
    reason = (F.when(~F.col("series").isin(*series), "non-equity series")
              .when(F.col("volume") <= 0, "zero volume").when(F.col("close") < min_price, "below price floor")
              .when(F.col(turnover) < min_turnover, "below liquidity floor"))
    if drop_locked:
        reason = reason.when(locked, "circuit-locked")
    return day.withColumns({"circuit_locked": locked, "reason": reason})


def exclusion_counts(day: DataFrame, keys=()) -> DataFrame:
    return day.groupBy(*keys, F.coalesce("reason", F.lit("survived")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


def schema_issues(df: DataFrame, needed=("open", "high", "low", "close"), numeric=("open", "high", "low", "close", "volume")) -> list[str]:
    """Missing and non-numeric columns, read from the schema alone."""
    types = dict(df.dtypes)
    out = [f"missing {c}" for c in needed if c not in types]
    ok = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return out + [f"non-numeric {c}" for c in numeric if c in types and not (types[c] in ok or types[c].startswith("decimal"))]


def duplicate_keys(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def row_issues(df: DataFrame) -> DataFrame:
    """Per-bar checks as (symbol, session, check, severity), one pass over rows."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    missing = o.isNull() | h.isNull() | l.isNull() | c.isNull()
    nonpos = truth((o <= 0) | (h <= 0) | (l <= 0) | (c <= 0)) & ~missing
    broken = truth((h < l) | (h < o) | (h < c) | (l > o) | (l > c)) & ~missing

    def issue(p, check, sev):
        return F.when(p, F.struct(F.lit(check).alias("check"), F.lit(sev).alias("severity")))

    found = F.array_compact(F.array(
        issue(F.col("symbol").isNull(), "missing_symbol", "fatal"), issue(missing, "null_price", "fatal"),
        issue(nonpos, "non_positive_price", "fatal"), issue(broken, "ohlc_coherence", "fatal"),
        issue(truth(v < 0), "negative_volume", "fatal"), issue(v.isNull(), "null_volume", "warn"),
        issue(truth(v == 0), "zero_volume", "warn")))
    return df.select("symbol", "session", F.explode(found).alias("i")).select("symbol", "session", "i.*")


def stale_runs(df: DataFrame, need: int = STALE_RUN) -> DataFrame:
    """Longest run of unchanged closes per symbol, the first one on a tie."""
    w = Window.partitionBy("symbol").orderBy("session")
    flat = truth(F.col("close") == F.lag("close").over(w))
    d = df.withColumns({"__flat": flat, "__prev": F.lag("session").over(w)})
    d = d.withColumn("__isle", F.sum((~F.col("__flat")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.where("__flat").groupBy("symbol", "__isle").agg(
        F.count(F.lit(1)).alias("n"), F.min("__prev").alias("start"), F.max("session").alias("end"))
    best = runs.groupBy("symbol").agg(F.max_by(F.struct("n", "start", "end"), F.struct("n", -F.col("__isle"))).alias("r"))
    return best.select("symbol", (F.col("r.n") + 1).alias("rows"), "r.start", "r.end").where(F.col("r.n") >= need)


def discontinuities(df: DataFrame, actions: DataFrame | None = None, threshold: float = MOVE_LIMIT_PCT) -> DataFrame:
    """Opens far from the previous close that no known action date explains."""
    w = Window.partitionBy("symbol").orderBy("session")
    d = df.withColumn("prev_close", F.lag("close").over(w)).where("prev_close != 0")
    d = d.withColumn("gap_pct", (F.col("open") / F.col("prev_close") - 1.0) * 100.0).where(F.abs("gap_pct") >= threshold)
    if actions is not None:
        known = actions.select("symbol", F.col("ex_date").alias("session")).distinct()
        d = d.join(known, ["symbol", "session"], "left_anti")
    implied = F.col("prev_close") / F.when(F.col("open") > 0, F.col("open"))
    near = F.array_min(F.array(*[F.struct(F.abs(F.lit(k) - implied).alias("d"), F.lit(k).alias("k"), F.lit(n).alias("label"))
                                 for k, n in COMMON_RATIOS]))
    return d.select("symbol", "session", "prev_close", "open", "gap_pct", implied.alias("implied"),
                    F.when(truth(near["d"] < 0.15), near["label"]).otherwise("unexplained").alias("nearest"))


def extreme_returns(df: DataFrame, actions: DataFrame, limit: float = MOVE_LIMIT_PCT) -> DataFrame:
    """Close-to-close moves over the limit, tagged by whether an action explains them."""
    w = Window.partitionBy("symbol").orderBy("session")
    prev = F.lag("close").over(w)
    d = df.withColumn("ret", F.col("close") / F.nullif(prev, F.lit(0.0)) - 1.0).where(F.abs("ret") > limit / 100.0)
    known = actions.select("symbol", F.col("ex_date").alias("session"), F.lit(True).alias("hit")).distinct()
    return (d.join(known, ["symbol", "session"], "left")
            .select("symbol", "session", "ret", F.when(truth(F.col("hit")), "info").otherwise("warn").alias("severity")))


def session_issues(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions expected but absent (warn) and present but not expected (fatal)."""
    have = df.select("session").distinct()
    due = calendar.where("is_session").select(F.col("day").alias("session"))
    return (due.join(have, "session", "left_anti").withColumn("severity", F.lit("warn"))
            .unionByName(have.join(due, "session", "left_anti").withColumn("severity", F.lit("fatal"))))


def reference_issues(df: DataFrame, ref: DataFrame, tolerance_pct: float = 1.0) -> DataFrame:
    """Per symbol: bars compared with a second source and how many disagree."""
    j = df.select("symbol", "session", "close").join(
        ref.select("symbol", "session", F.col("close").alias("ref")), ["symbol", "session"], "left")
    diff = F.abs(F.col("close") - F.col("ref")) / F.nullif(F.col("ref"), F.lit(0.0)) * 100.0
    g = j.groupBy("symbol").agg(F.count("ref").alias("overlap"), F.count_if(diff > tolerance_pct).alias("off"), F.max(diff).alias("worst_pct"))
    return g.withColumn("status", F.when(F.col("overlap") == 0, "no overlap").when(F.col("off") > 0, "warn").otherwise("ok"))


def check_panel(df: DataFrame, actions: DataFrame) -> DataFrame:
    """All checks of all symbols: (symbol, check, severity, rows, sample).

    The sample is the five earliest dates, kept as a bounded min-heap style
    aggregate: dates are ranked within a check before they are collected.
    """
    rows = row_issues(df)
    dup = duplicate_keys(df).select("symbol", "session", F.lit("duplicate_session").alias("check"), F.lit("fatal").alias("severity"))
    gaps = discontinuities(df, actions).select("symbol", "session", F.lit("discontinuity").alias("check"), F.lit("fatal").alias("severity"))
    ext = extreme_returns(df, actions).select("symbol", "session", F.lit("extreme_return").alias("check"), "severity")
    allrows = reduce(DataFrame.unionByName, (rows, dup, gaps, ext))
    per = allrows.groupBy("symbol", "check", "severity").agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("symbol", "check", "severity").orderBy("session")
    first = (allrows.withColumn("__k", F.row_number().over(w)).where("__k <= 5")
             .groupBy("symbol", "check", "severity").agg(F.array_sort(F.collect_list("session")).alias("sample")))
    out = per.join(first, ["symbol", "check", "severity"])
    bars = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    heavy = (F.col("check") == "zero_volume") & (100.0 * F.col("rows") / F.col("bars") >= ZERO_VOLUME_FATAL_PCT)
    out = out.join(bars, "symbol").withColumn("severity", F.when(heavy, "fatal").otherwise(F.col("severity"))).drop("bars")
    stale = stale_runs(df).select("symbol", F.lit("stale_quote").alias("check"), F.lit("warn").alias("severity"), "rows",
                                  F.array("start", "end").alias("sample"))
    return out.unionByName(stale)


def assert_clean(df: DataFrame, actions: DataFrame) -> None:
    bad = check_panel(df, actions).where("severity = 'fatal'").limit(1).take(1)
    if bad:
        raise QualityError(f"{bad[0]['symbol']}: {bad[0]['check']}")


def vet(shortlist: DataFrame, report: DataFrame) -> DataFrame:
    """Shortlisted names without a fatal issue; their order is their rank column."""
    fatal = report.where("severity = 'fatal'").select("symbol").distinct()
    return shortlist.join(fatal, "symbol", "left_anti")


# ---- adjustment ----------------------------------------------------------

def adjustment_steps(bars: DataFrame, actions: DataFrame, as_of=None, dividends: bool = False) -> DataFrame:
    """One multiplier per usable action on (symbol, ex_date).

    Splits and bonuses divide; a dividend scales by the last close before the
    ex date and is skipped when it is not smaller than that close.
    """
    a = actions if as_of is None else actions.where(F.col("ex_date") <= F.lit(as_of).cast("date"))
    steps = (a.where(F.col("type").isin("split", "bonus"))
             .select("symbol", "ex_date", F.log(1.0 / F.col("factor")).alias("lnf")))
    if dividends:
        d = a.where("type = 'dividend'").select("symbol", F.col("ex_date").alias("session"), F.lit(0).alias("k"), "amount",
                                                F.lit(None).cast("double").alias("close"))
        b = bars.select("symbol", "session", F.lit(1).alias("k"), F.lit(None).cast("double").alias("amount"), "close")
        w = Window.partitionBy("symbol").orderBy("session", "k").rowsBetween(Window.unboundedPreceding, -1)
        ref = F.last("close", ignorenulls=True).over(w)
        d = (d.unionByName(b).withColumn("ref", ref).where("k = 0 AND ref > 0 AND amount < ref")
             .select("symbol", F.col("session").alias("ex_date"), F.log((F.col("ref") - F.col("amount")) / F.col("ref")).alias("lnf")))
        steps = steps.unionByName(d)
    return steps


def factor_intervals(steps: DataFrame) -> DataFrame:
    """Per symbol the ex dates in order, each with the product of its factor and all later ones: ``cuts``.

    From one such date to the next the adjustment factor is the later date's
    product, so actions alone tell the factor of every session.
    """
    per_day = steps.groupBy("symbol", "ex_date").agg(F.sum("lnf").alias("lnf"))
    later = Window.partitionBy("symbol").orderBy(F.desc("ex_date")).rowsBetween(Window.unboundedPreceding, 0)
    rows = per_day.withColumn("factor", F.exp(F.sum("lnf").over(later)))
    return rows.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ex_date", "factor"))).alias("cuts"))


def adjust(bars: DataFrame, actions: DataFrame, as_of=None, dividends: bool = False) -> DataFrame:
    """Back-adjusted prices and volume beside the raw ones.

    A bar's factor is the product over actions with a later ex date. Bars meet
    their symbol's factor intervals, a row with a few dates, and look their own
    session up in it: they are neither sorted nor paired with actions, and stay
    where they are if the intervals are small enough to be sent to them.
    """
    cuts = factor_intervals(adjustment_steps(bars, actions, as_of, dividends))
    ahead = F.get(F.filter("__cuts", lambda c: c["ex_date"] > F.col("session")), F.lit(0))["factor"]
    both = (bars.join(cuts.select("symbol", F.col("cuts").alias("__cuts")), "symbol", "left")
            .withColumn("adj_factor", F.coalesce(ahead, F.lit(1.0))).select(*bars.columns, "adj_factor"))
    return both.withColumns({**{f"adj_{c}": F.col(c) * F.col("adj_factor") for c in ("open", "high", "low", "close")},
                             "adj_volume": F.col("volume") / F.col("adj_factor")})


# ---- screens -------------------------------------------------------------

class ScreenError(ValueError):
    """A screen names a field the table does not have."""


def _test(field: str, op: str, value) -> Column:
    c = F.col(field)
    ops = {"gt": c > value, "lt": c < value, "gte": c >= value, "lte": c <= value, "eq": c == value}
    return truth(ops[op])


def passes(df: DataFrame, rules) -> Column:
    """AND of (field, op, value); NULL never passes; unknown fields refuse."""
    missing = sorted({f for f, _, _ in rules} - set(df.columns))
    if missing:
        raise ScreenError(f"screen needs fields {missing}")
    return reduce(lambda a, b: a & b, [_test(*r) for r in rules])


def screen_report(df: DataFrame, screens: dict) -> DataFrame:
    """Pass count per screen, or the fields it lacks, from one aggregate."""
    ready, blocked = {}, {}
    for name, rules in screens.items():
        miss = sorted({f for f, _, _ in rules} - set(df.columns))
        (blocked if miss else ready)[name] = miss or passes(df, rules)
    one = df.agg(*[F.count_if(p).alias(n) for n, p in ready.items()], F.count(F.lit(1)).alias("__all"))
    rows = [F.struct(F.lit(n).alias("screen"), F.col(n).alias("passed"), F.lit(None).cast("string").alias("missing")) for n in ready]
    rows += [F.struct(F.lit(n).alias("screen"), F.lit(None).cast("long").alias("passed"), F.lit(",".join(m)).alias("missing"))
             for n, m in blocked.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
