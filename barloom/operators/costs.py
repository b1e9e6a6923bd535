"""Costs and slippage as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import col
from ..functions.selection import with_quantiles


@dataclass(frozen=True)
class CostModel:
    # Statutory and exchange charges in percent, depository fee, slippage.
    stt_sell_pct: float = 0.1
    exchange_txn_pct: float = 0.00297
    sebi_turnover_pct: float = 0.0001
    stamp_duty_buy_pct: float = 0.015
    gst_pct: float = 18.0
    brokerage_pct: float = 0.0
    dp_charge: float = 15.93
    slippage_bps: float = 15.0

    def side_pct(self, side: str) -> float:
        """Charges of one side as percent of its value."""
        taxed = self.brokerage_pct + self.exchange_txn_pct + self.sebi_turnover_pct
        extra = {"buy": self.stamp_duty_buy_pct, "sell": self.stt_sell_pct}[side]
        return taxed * (1 + self.gst_pct / 100.0) + extra

    def round_trip(self, entry, exit_, qty) -> Column:
        """Charges and slippage of both sides in money."""
        e, x = F.abs(col(entry) * col(qty)), F.abs(col(exit_) * col(qty))
        slip = self.slippage_bps / 10_000.0
        return (e * (self.side_pct("buy") / 100.0 + slip) + x * (self.side_pct("sell") / 100.0 + slip))

    def round_trip_pct(self, position_value=None) -> Column:
        """Both sides as percent of the position; the flat fee needs its size."""
        pct = F.lit(self.side_pct("buy") + self.side_pct("sell") + 2 * self.slippage_bps / 100.0)
        if position_value is None:
            return pct
        v = col(position_value)
        return pct + F.when(v > 0, self.dp_charge / v * 100.0).otherwise(0.0)

    def cost_r(self, stop_pct, position_value=None) -> Column:
        s = col(stop_pct)
        return self.round_trip_pct(position_value) / F.when(s > 0, s)

    def breakeven_position(self, stop_pct, gross_edge_r) -> Column:
        """Smallest position whose edge pays the flat fee; NULL when none does."""
        budget = col(gross_edge_r) * col(stop_pct) - self.round_trip_pct()
        return self.dp_charge / F.when(budget > 0, budget) * 100.0

    def min_risk_pct(self, max_share_of_stop_pct: float = 25.0) -> float:
        """Stop distance under which slippage alone takes the allowed share."""
        return self.slippage_bps / max_share_of_stop_pct


@dataclass(frozen=True)
class SlippageModel:
    # Base and impact in basis points.
    base_bps: float = 2.0
    impact_bps: float = 35.0
    form: str = "sqrt"
    atr_multiplier: float = 0.0
    min_bps: float = 0.0
    max_bps: float = 500.0

    def bps(self, participation, atr_pct=None) -> Column:
        p = col(participation)
        vol = F.lit(0.0)
        if self.atr_multiplier > 0 and atr_pct is not None:
            vol = F.coalesce(F.when(col(atr_pct) > 0, self.atr_multiplier * col(atr_pct) * 100.0), vol)
        share = F.least(p, F.lit(1.0))
        shaped = F.sqrt(share) if self.form == "sqrt" else share
        raw = self.base_bps + F.coalesce(F.when(p > 0, self.impact_bps * shaped), F.lit(0.0)) + vol
        return F.least(F.lit(self.max_bps), F.greatest(F.lit(self.min_bps), raw))

    def breakeven_atr_multiplier(self, gross_r, stop_pct, atr_pct, statutory_pct: float = 0.1222) -> Column:
        budget = col(gross_r) * col(stop_pct) - statutory_pct
        return F.when((budget > 0) & (col(atr_pct) > 0), budget / (2.0 * col(atr_pct)))


def retail_bound(df: DataFrame, turnover, position_value: float, keys=(),
                 model: SlippageModel = SlippageModel()) -> DataFrame:
    """Median and 95th percentile of participation and slippage over turnover."""
    d = df.where(col(turnover) > 0).withColumn("__p", position_value / col(turnover))
    d = d.withColumn("__b", model.bps("__p"))
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    out = with_quantiles(out, d, keys, "__p", {"p50": 0.5, "p95": 0.95})
    out = with_quantiles(out, d, keys, "__b", {"median_bps": 0.5, "p95_bps": 0.95})
    return out.select(*keys, (100.0 * F.col("p50")).alias("median_participation_pct"), (100.0 * F.col("p95")).alias("p95_participation_pct"),
                      "median_bps", "p95_bps", (2.0 * F.col("median_bps") / 100.0).alias("median_round_trip_pct"))
