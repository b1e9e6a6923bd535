"""From a ranked feature row to a sized trade: proposal, hard gates, allocation."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import above, col, first_reason, truth

# Closed vocabularies.
DIRECTION = {"Buy": 1, "Overweight": 1, "Hold": 0, "Underweight": -1, "Sell": -1, "REVIEW": 0}
REGIMES = ("trending_up", "trending_down", "range", "high_vol", "crisis", "unknown")
TEMPORARY_REASONS = ("position_value_cap", "sector_cap", "portfolio_heat_cap", "correlated_cap",
                     "daily_loss_cap", "drawdown_cap", "max_open_positions", "stale_data",
                     "market_risk_off", "event_in_window")
EXIT_REASONS = ("stop", "target", "time", "strategy_exit", "manual")


@dataclass(frozen=True)
class RiskConfig:
    # Default risk limits, in percent of capital unless named otherwise.
    capital: float = 1_000_000.0
    risk_pct: float = 0.5
    max_position_pct: float = 15.0
    max_sector_pct: float = 30.0
    max_open_risk_pct: float = 4.0
    max_correlated_pct: float = 25.0
    max_open_positions: int = 5
    min_risk_reward: float = 1.5
    max_adv_participation_pct: float = 1.0
    max_stop_distance_pct: float = 15.0
    lot_size: int = 1
    max_slippage_pct: float = 0.5
    max_slippage_share_of_stop_pct: float = 25.0
    max_instrument_atr_pct: float = 12.0
    vol_reference_atr_pct: float | None = None
    risk_off_exposure_pct: float = 0.0
    max_staleness_days: int = 5
    max_daily_loss_pct: float = 3.0
    max_drawdown_pct: float | None = None


def direction(stance) -> Column:
    m = F.create_map(*[F.lit(x) for kv in DIRECTION.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col(stance)), F.lit(0))


def propose(features: DataFrame, stop_atrs: float = 2.0, target_r: float = 2.0,
            buffer_atrs: float = 0.25, min_stop_atrs: float = 1.0) -> DataFrame:
    """Entry at the close, stop under the level the setup rests on.

    The nearest of swing low and 20-session low below the entry carries the
    stop, a buffer beneath it; a stop inside one ATR is widened to one ATR;
    without a level the stop is a volatility stop.
    """
    entry = F.col("close")
    f = features.where((F.col("close") > 0) & (F.col("atr_pct") > 0)).withColumn(
        "atr_money", F.col("close") * F.col("atr_pct") / 100.0)
    swing = F.when((F.col("swing_low") > 0) & (F.col("swing_low") < entry), F.col("swing_low"))
    low20 = F.when((F.col("low_20") > 0) & (F.col("low_20") < entry), F.col("low_20"))
    level = F.greatest(swing, low20)
    kind = F.when(truth(swing >= F.coalesce(low20, swing)), "swing_low").when(low20.isNotNull(), "low_20").otherwise("atr")
    under = level - buffer_atrs * F.col("atr_money")
    floor = entry - min_stop_atrs * F.col("atr_money")
    stop = F.when(level.isNull(), entry - stop_atrs * F.col("atr_money")).otherwise(F.least(under, floor))
    basis = F.when(level.isNotNull() & (under > floor), "noise_floor").otherwise(kind)
    return (f.withColumns({"entry": entry, "level": level, "stop": stop, "stop_basis": basis})
            .where(F.col("stop") > 0)
            .withColumn("target", entry + target_r * (entry - F.col("stop")))
            .withColumn("adv_shares", F.col("volume")))


def gate_reason(cfg: RiskConfig = RiskConfig(), slippage="expected_slippage_pct", tradeable="tradeable",
                age="data_age_days", risk_off: bool | Column = False) -> Column:
    """First hard gate a single trade fails, in the fixed order, else NULL. ``risk_off``: for all rows, or a condition."""
    e, s, t = F.col("entry"), F.col("stop"), F.col("target")
    dist = F.abs(e - s)
    slip = col(slippage)
    bad = [F.isnan(c) | (F.abs(c) == float("inf")) for c in (e, s, t, F.col("atr_pct"), slip, F.col("adv_shares"))]
    malformed = bad[0]
    for b in bad[1:]:
        malformed = truth(malformed) | truth(b)
    return first_reason([
        ("not_tradeable", ~truth(col(tradeable))),
        ("stale_data", col(age) > cfg.max_staleness_days),
        ("market_risk_off", truth(F.lit(risk_off) if isinstance(risk_off, bool) else risk_off) & F.lit(cfg.risk_off_exposure_pct <= 0)),
        ("extreme_volatility", F.col("atr_pct") > cfg.max_instrument_atr_pct),
        ("malformed_input", malformed),
        ("illiquid_vs_adv", F.col("adv_shares") <= 0),
        ("extreme_volatility", F.col("atr_pct") <= 0),
        ("stop_too_wide", (dist <= 0) | (e <= 0) | (100.0 * dist / above(e) > cfg.max_stop_distance_pct)),
        ("risk_reward_too_low", F.abs(t - e) / above(dist) < cfg.min_risk_reward),
        ("slippage_too_high", (slip > cfg.max_slippage_pct)
         | (slip * e / above(dist) > cfg.max_slippage_share_of_stop_pct)),
    ])


@dataclass
class Book:
    """An account between two decisions: open positions, and what closed ones left.

    A position is (symbol, quantity, entry, risk, sector, cluster, exit day, P&L at
    that exit). Equity is the capital and what positions have realised.
    """
    positions: list[tuple]
    equity: float
    peak: float
    today: float = 0.0

    def open_day(self, day) -> None:
        """Close what has reached its exit by ``day``; only exits of that very day are today's result."""
        due = [p for p in self.positions if p[6] is not None and p[6] <= day]
        self.positions = [p for p in self.positions if p[6] is None or p[6] > day]
        self.today = sum(p[7] for p in due if p[6] == day)
        self.equity += sum(p[7] for p in due)
        self.peak = max(self.peak, self.equity)

    @property
    def drawdown_pct(self) -> float:
        return max(0.0, (self.peak - self.equity) / self.peak * 100.0) if self.peak > 0 else 0.0

    def value(self, at: int, name) -> float:
        return sum(p[1] * p[2] for p in self.positions if p[at] == name)


def _size(row, book: Book, cfg: RiskConfig) -> tuple[str | None, int]:
    """(reason, quantity) of one candidate against the book, gates in the fixed order."""
    cap = cfg.capital
    lots = lambda q: int(q // cfg.lot_size * cfg.lot_size)
    if row.event:
        return "event_in_window", 0
    if isinstance(row.gate, str):
        return row.gate, 0
    if len(book.positions) >= cfg.max_open_positions and not any(p[0] == row.symbol for p in book.positions):
        return "max_open_positions", 0
    if -book.today >= cap * cfg.max_daily_loss_pct / 100.0:
        return "daily_loss_cap", 0
    if cfg.max_drawdown_pct is not None and book.drawdown_pct >= cfg.max_drawdown_pct:
        return "drawdown_cap", 0
    dist, risk_pct = abs(row.entry - row.stop), cfg.risk_pct
    if cfg.vol_reference_atr_pct and row.atr_pct > 0:
        risk_pct = risk_pct * min(1.0, cfg.vol_reference_atr_pct / row.atr_pct)
    if row.risk_off:
        if cfg.risk_off_exposure_pct <= 0:
            return "market_risk_off", 0
        risk_pct = risk_pct * cfg.risk_off_exposure_pct / 100.0
    qty = lots(cap * risk_pct / 100.0 / dist)
    if qty <= 0:
        return "qty_rounds_to_zero", 0
    held, limit = book.value(0, row.symbol), cap * cfg.max_position_pct / 100.0
    if held + qty * row.entry > limit:
        qty = lots((limit - held) / row.entry) if limit > held else 0
        if qty <= 0:
            return "position_value_cap", 0
    value = qty * row.entry
    if book.value(4, row.sector) + value > cap * cfg.max_sector_pct / 100.0:
        return "sector_cap", 0
    if row.cluster is not None and book.value(5, row.cluster) + value > cap * cfg.max_correlated_pct / 100.0:
        return "correlated_cap", 0
    if sum(p[3] for p in book.positions) + qty * dist > cap * cfg.max_open_risk_pct / 100.0:
        return "portfolio_heat_cap", 0
    if row.adv_shares > 0 and 100.0 * qty / row.adv_shares > cfg.max_adv_participation_pct:
        qty = lots(row.adv_shares * cfg.max_adv_participation_pct / 100.0)
        if qty <= 0:
            return "illiquid_vs_adv", 0
    return None, qty


WALKED = ("session date, symbol string, rank int, approved boolean, reason string, qty long, position_value double, capital_at_risk double, "
          "open_positions int, realised_today double, equity double, drawdown_pct double")


def _walk(g: pd.DataFrame, cfg: RiskConfig, max_trades: int) -> list[tuple]:
    """Candidates of one book, session by session and rank by rank; a session ends once ``max_trades`` stand."""
    book, out, day, stood = Book([], cfg.capital, cfg.capital), [], None, 0
    none = lambda x: None if pd.isna(x) else x
    for row in g.sort_values(["session", "rank", "symbol"]).itertuples(index=False):
        row = row._replace(**{c: none(getattr(row, c)) for c in ("cluster", "sector", "gate", "exit_on", "exit_value")})
        if row.session != day:
            day, stood = row.session, 0
            book.open_day(day)
        if stood >= max_trades:
            continue
        why, qty = _size(row, book, cfg)
        value, risk = qty * row.entry, qty * abs(row.entry - row.stop)
        out.append((day, row.symbol, row.rank, why is None, why, qty, value, risk,
                    len(book.positions), book.today, book.equity, book.drawdown_pct))
        if why is None:
            stood += 1
            book.positions.append((row.symbol, qty, row.entry, risk, row.sector, row.cluster or row.sector, row.exit_on,
                                   qty * row.exit_value if row.exit_value is not None else 0.0))
    return out


def walk_book(candidates: DataFrame, cfg: RiskConfig = RiskConfig(), max_trades: int = 3, top: int = 20, keys=()) -> DataFrame:
    """Approve names session by session against one book that is carried on.

    Each approval uses up sector, cluster and heat room for those after it, until
    its exit: ``exit_on`` (null: stays open) and ``exit_value``, the gain of one
    share by then. What exits on the session itself is that day's result, on which
    the daily loss cap works; the drawdown cap works on realised equity against
    its high over the sessions walked. A name with ``event`` (one falls into the
    holding window) is refused before it is sized. ``risk_off`` scales the risk of
    a session down to the allowed share, none refuses it. A null cluster is no
    claim, so that cap does not run.

    ``candidates``: session, symbol, score, entry, stop, atr_pct, adv_shares,
    sector, cluster, gate, event, risk_off, exit_on, exit_value, and ``keys`` that
    tell books apart. A book is one fold over at most ``top`` rows a session, cut
    by a group limit that Spark applies before the shuffle.
    """
    w = Window.partitionBy(*keys, "session").orderBy(F.desc("score"), "symbol")
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    names = [f.split()[0] for f in WALKED.split(", ")]
    cols = ("session", "symbol", "rank", "entry", "stop", "atr_pct", "adv_shares", "sector", "cluster", "gate", "event", "risk_off", "exit_on", "exit_value")
    key_types = "".join(f"{k} {dict(candidates.dtypes)[k]}, " for k in keys)

    def walk(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_walk(g, cfg, max_trades), columns=names)
        for k, v in zip(keys, key):
            out[k] = v
        return out[[*keys, *names]]

    books = ranked.select(*keys, *cols) if keys else ranked.select(*cols, F.lit(0).alias("__book"))
    return books.groupBy(*(keys or ["__book"])).applyInPandas(walk, key_types + WALKED)


def allocate(candidates: DataFrame, cfg: RiskConfig = RiskConfig(), max_trades: int = 3,
             top: int = 20) -> DataFrame:
    """``walk_book`` with an empty book at every session: sessions are independent and spread out."""
    flat = candidates.withColumns({"event": F.lit(False), "risk_off": F.lit(False), "exit_on": F.lit(None).cast("date"),
                                   "exit_value": F.lit(None).cast("double"), "__day": F.col("session")})
    return walk_book(flat, cfg, max_trades, top, ["__day"]).select(
        "session", "symbol", "rank", "approved", "reason", "qty", F.round("position_value", 2).alias("position_value"),
        F.round("capital_at_risk", 2).alias("capital_at_risk"))


def exposure(positions: DataFrame, keys=("session",)) -> DataFrame:
    """Open risk and exposure sums of a book, with its widest sector."""
    p = positions.withColumns({"value": F.abs("qty") * F.col("entry"),
                               "risk": F.abs("qty") * F.abs(F.col("entry") - F.col("stop"))})
    per = p.groupBy(*keys, "sector").agg(F.sum("value").alias("v"), F.sum("risk").alias("k"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("positions"), F.sum("k").alias("open_risk"),
                                  F.sum("v").alias("exposure"), F.max("v").alias("largest_sector_exposure"))


# ---- strategy proposals --------------------------------------------------

# The catalogue of strategies, their hostile regimes and maturity.
CATALOGUE = (
    ("supertrend_adx", ("range", "high_vol"), "audited", False),
    ("bollinger_rsi", ("trending_down", "crisis"), "audited", True),
    ("donchian_breakout", ("range",), "audited", True),
    ("opening_range_breakout", ("range",), "draft", False),
    ("ml_classifier", ("crisis",), "draft", False),
)
TRUSTED = ("walk_forward", "paper", "live")


def catalogue(spark) -> DataFrame:
    row = lambda k, h, m, i: F.struct(
        F.lit(k).alias("strategy"), F.array(*[F.lit(x) for x in h]).alias("hostile"),
        F.lit(m).alias("maturity"), F.lit(i).alias("implemented"), F.lit(m in TRUSTED).alias("trusted"))
    return spark.range(1).select(F.explode(F.array(*[row(*c) for c in CATALOGUE])).alias("c")).select("c.*")


def strategy_status(spark, regime: str, trusted_only: bool = False) -> DataFrame:
    c = catalogue(spark)
    silent = F.array_contains("hostile", regime)
    return c.select("strategy", F.when(silent, "silenced: hostile regime")
                    .when(F.lit(trusted_only) & ~F.col("trusted"), "silenced: below the trusted threshold")
                    .when(~F.col("implemented"), "unimplemented").otherwise("proposing").alias("status"))


def donchian_proposals(f: DataFrame, atr_mult: float = 2.0) -> DataFrame:
    """Close above the prior 20-session high; ATR stop; 2R target."""
    stop = F.col("close") * (1 - atr_mult * F.col("atr_pct") / 100.0)
    hit = f.where((F.col("close") > F.col("prior_high_20")) & (F.col("prior_high_20") > 0)
                  & (F.col("atr_pct") > 0) & (stop > 0))
    return hit.select(*_keys(f), F.lit("donchian_breakout").alias("strategy"), F.col("close").alias("entry"),
                      stop.alias("stop"), (F.col("close") + 2 * (F.col("close") - stop)).alias("target"),
                      (100.0 * (F.col("close") / F.col("prior_high_20") - 1)).alias("stretch"), "atr_pct")


def bollinger_proposals(f: DataFrame, oversold: float = 30.0, k: float = 2.0) -> DataFrame:
    """Close under the lower band with RSI washed out; revert to the mean."""
    sigma = (F.col("bb_mid") - F.col("bb_lower")) / k
    stop = F.col("bb_mid") - (k + 1) * sigma
    risk = F.col("close") - stop
    hit = f.where((F.col("close") > 0) & (F.col("bb_mid") > F.col("close")) & (F.col("atr_pct") > 0)
                  & (F.col("close") <= F.col("bb_lower")) & (F.col("rsi_14") <= oversold) & (sigma > 0)
                  & (stop > 0) & (risk > 0) & (risk >= 0.5 * F.col("close") * F.col("atr_pct") / 100.0))
    return hit.select(*_keys(f), F.lit("bollinger_rsi").alias("strategy"), F.col("close").alias("entry"),
                      stop.alias("stop"), F.col("bb_mid").alias("target"),
                      ((F.col("bb_mid") - F.col("close")) / sigma).alias("stretch"), "atr_pct")


def _keys(f: DataFrame):
    return [c for c in ("session", "symbol") if c in f.columns]


#: name -> DataFrame to DataFrame
ADAPTERS = {"donchian_breakout": donchian_proposals, "bollinger_rsi": bollinger_proposals}


def propose_all(f: DataFrame, regime: str, limit: int | None = None) -> DataFrame:
    """Proposals of every adapter the regime allows, most stretched first."""
    hostile = {k: h for k, h, _, _ in CATALOGUE}
    allowed = [fn for k, fn in ADAPTERS.items() if regime not in hostile[k]]
    if not allowed:
        raise ValueError(f"every strategy is silenced in {regime}")
    out = allowed[0](f)
    for fn in allowed[1:]:
        out = out.unionByName(fn(f))
    if limit is None:
        return out
    part = ["strategy"] + (["session"] if "session" in out.columns else [])
    rn = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("stretch"), "symbol"))
    return out.withColumn("n", rn).where(F.col("n") <= limit).drop("n")


def proposal_errors() -> Column:
    """Every incoherence of a proposal, deduplicated; empty when it is sound."""
    d, e, s, t = direction("stance"), F.col("entry"), F.col("stop"), F.col("target")
    def odd(c):
        return truth(F.isnan(c) | (F.abs(c) == float("inf")))
    rules = [
        (truth(F.aggregate("fractions", F.lit(0.0), lambda a, x: a + x) > 1.0 + 1e-9), "fractions over one"),
        *[(odd(F.col(c)), f"{c} not finite") for c in ("entry", "stop", "target")],
        (truth((d > 0) & (s >= e)), "stop not below a long entry"),
        (truth((d < 0) & (s <= e)), "stop not above a short entry"),
        (truth((d > 0) & (t <= e)), "target not above a long entry"),
        (truth((d < 0) & (t >= e)), "target not below a short entry")]
    return F.array_distinct(F.array_compact(F.array(*[F.when(p, F.lit(m)) for p, m in rules])))


def shortlists(rejected: DataFrame, reasons: str = "reasons") -> DataFrame:
    """A rejection with any temporary reason is watched; the rest is avoided."""
    parts = F.transform(F.split(F.col(reasons), ","), lambda x: F.trim(x))
    temp = F.array(*[F.lit(x) for x in TEMPORARY_REASONS])
    return rejected.withColumn("list", F.when(F.arrays_overlap(parts, temp), "watch").otherwise("avoid"))


def no_trade_reasons(rejected: DataFrame, keys=(), top: int = 3, reasons: str = "reasons") -> DataFrame:
    """Most frequent rejection reasons."""
    n = (rejected.select(*keys, F.explode(F.split(F.col(reasons), ",")).alias("reason"))
         .withColumn("reason", F.trim("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n")))
    if not keys:
        return n.orderBy(F.desc("n"), "reason").limit(top)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "reason"))
    return n.withColumn("rn", rn).where(F.col("rn") <= top).drop("rn")
