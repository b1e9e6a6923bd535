"""Declarative entry rules: named indicators, operands, comparisons, AND.

A rule is data. It compiles to a list of Columns, so every rule over a panel is
one projection on the shared windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import frames as W
from ..functions.ewm import ewm, span_alpha
from ..functions.scalars import all_of, truth
from . import indicators as ind
from .panel import densify


@dataclass(frozen=True)
class Ind:
    """An indicator by name: kind, source column, length and a component."""
    name: str
    kind: str
    length: int = 20
    source: str = "close"
    mult: float = 2.0
    component: str = ""


@dataclass(frozen=True)
class Cond:
    """left op right; an operand is an indicator name, a price column or a number."""
    left: object
    op: str
    right: object


@dataclass(frozen=True)
class Rule:
    key: str
    indicators: tuple[Ind, ...]
    conditions: tuple[Cond, ...]
    stop_pct: float
    take_pct: float

    def supported(self) -> bool:
        return self.stop_pct > 0 and self.take_pct / self.stop_pct >= 2.0


def _donchian(i: Ind) -> Column:
    d = ind.donchian(i.length)
    if i.component == "middle":
        return (d["donchian_high"] + d["donchian_low"]) / 2.0
    return d["donchian_low" if i.component == "lower" else "donchian_high"]


#: indicator kinds that are plain window Columns
WINDOWED = {
    "sma": lambda i: W.sma(i.source, i.length),
    "bbands": lambda i: ind.bollinger(i.source, i.length, i.mult, sample=False)[f"bb_{i.component or 'mid'}"],
    "donchian": _donchian,
    "highest": lambda i: ind.extreme_prior(i.source, i.length, "highest"),
    "lowest": lambda i: ind.extreme_prior(i.source, i.length, "lowest"),
}


def with_indicators(df: DataFrame, wanted: tuple[Ind, ...], **kw) -> DataFrame:
    for i in wanted:
        if i.kind == "ema":
            df = ewm(df, {i.name: (i.source, span_alpha(i.length))}, **kw)
        elif i.kind == "rsi":
            df = ind.rsi(df, i.length, i.source, out=i.name, **kw)
        elif i.kind == "macd":
            df = ind.macd(df, i.source, **kw).withColumn(
                i.name, F.col({"signal": "macd_signal", "hist": "macd_hist"}.get(i.component, "macd")))
        elif i.kind not in WINDOWED:
            raise ind.IndicatorError(f"unknown indicator {i.kind}")
    return df.withColumns({i.name: WINDOWED[i.kind](i) for i in wanted if i.kind in WINDOWED})


def _side(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def _before(x) -> Column:
    return W.shift(x) if isinstance(x, str) else F.lit(float(x))


def compare(c: Cond) -> Column:
    a, b = _side(c.left), _side(c.right)
    ops = {"gt": a > b, "lt": a < b, "gte": a >= b, "lte": a <= b}
    if c.op in ops:
        return truth(ops[c.op])
    pa, pb = _before(c.left), _before(c.right)
    if c.op == "cross_above":
        return truth((a > b) & (pa <= pb))
    if c.op == "cross_below":
        return truth((a < b) & (pa >= pb))
    raise ind.IndicatorError(f"unknown comparison {c.op}")


def fires(rule: Rule) -> Column:
    return all_of([compare(c) for c in rule.conditions])


def signals(df: DataFrame, rule: Rule, **kw) -> DataFrame:
    """The panel with a boolean ``signal``; null operands never signal."""
    if not rule.supported():
        raise ind.IndicatorError(f"{rule.key}: needs a positive stop and take/stop of at least 2")
    # a smoothed operand keeps its level over an untraded session, and a cross
    # looks at it there: such rules run on the dense panel
    if any(i.kind in ("ema", "rsi", "macd") for i in rule.indicators):
        df = densify(df)
    df = with_indicators(df, rule.indicators, **kw)
    df = df.withColumn("signal", fires(rule))
    return df.where("traded").drop("traded") if "traded" in df.columns else df


# Standard public parameters; the closed library the rules come from is not available.
RULES = {r.key: r for r in (
    Rule("donchian_breakout", (Ind("hi", "donchian", 20, component="upper"),),
         (Cond("close", "gt", "hi"),), 5.0, 10.0),
    Rule("sma_cross", (Ind("fast", "sma", 5), Ind("slow", "sma", 20)),
         (Cond("fast", "cross_above", "slow"),), 5.0, 10.0),
    Rule("rsi_reversal", (Ind("r", "rsi", 14),), (Cond("r", "cross_above", 30),), 4.0, 8.0),
    Rule("macd_cross", (Ind("m", "macd"), Ind("s", "macd", component="signal")),
         (Cond("m", "cross_above", "s"),), 5.0, 10.0),
    Rule("bollinger_reversion", (Ind("lo", "bbands", 20, component="lower"),),
         (Cond("close", "cross_above", "lo"),), 4.0, 8.0),
    Rule("range_breakout", (Ind("top", "highest", 10, "close"), Ind("avg", "ema", 20)),
         (Cond("close", "gt", "top"), Cond("close", "gt", "avg")), 5.0, 10.0),
)}
