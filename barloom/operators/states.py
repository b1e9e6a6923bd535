"""Path-dependent indicators that no running sum can express.

Their state at a bar depends non-linearly on the state at the previous bar, so
each symbol's bars (at most one per session) go through one grouped Arrow call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _by_symbol(df: DataFrame, fn, extra: str, cols) -> DataFrame:
    src = df.select("symbol", "session", "idx", *cols)
    return src.groupBy("symbol").applyInPandas(
        lambda g: fn(g.sort_values("idx", ignore_index=True)),
        f"symbol string, session date, idx int, {extra}")


def parabolic_sar(df: DataFrame, step: float = 0.02, cap: float = 0.2) -> DataFrame:
    """Stop-and-reverse level and side (+1 rising, -1 falling) per bar.

    Seeded by the first two panel sessions. The recursion has no value to
    continue from across a missing session, so it stays NULL from there on.
    """
    def walk(g: pd.DataFrame) -> pd.DataFrame:
        n = len(g)
        run = int(np.cumprod(g["idx"].to_numpy() == np.arange(n)).sum())
        level, side = np.full(n, np.nan), np.zeros(n, dtype="int64")
        # +1 rising / -1 falling; a falling market is a rising one mirrored
        up, dn = g["high"].to_numpy(float), g["low"].to_numpy(float)
        if run >= 2:
            d = 1 if up[1] >= up[0] else -1
            far, near = (up, dn) if d == 1 else (-dn, -up)
            stop, peak, accel = near[0], far[1], step
            level[1], side[1] = d * stop, d
            for i in range(2, run):
                stop = min(stop + accel * (peak - stop), near[i - 1], near[i - 2])
                if near[i] < stop:
                    d, far, near = -d, -near, -far
                    stop, peak, accel = -peak, far[i], step
                elif far[i] > peak:
                    peak, accel = far[i], min(accel + step, cap)
                level[i], side[i] = d * stop, d
        return g[["symbol", "session", "idx"]].assign(
            sar=pd.Series(level).astype(object).where(~np.isnan(level), None), sar_side=side)

    return _by_symbol(df, walk, "sar double, sar_side long", ("high", "low"))


def supertrend(df: DataFrame, mult: float = 3.0) -> DataFrame:
    """Carried ATR bands and the side price is on. Needs an ``atr`` column."""
    def walk(g: pd.DataFrame) -> pd.DataFrame:
        mid = (g["high"] + g["low"]).to_numpy(float) / 2.0
        close, atr = g["close"].to_numpy(float), g["atr"].to_numpy(float)
        n = len(g)
        line, side = np.full(n, np.nan), np.ones(n, dtype="int64")
        top = bottom = np.nan
        for i in range(n):
            t, b = mid[i] + mult * atr[i], mid[i] - mult * atr[i]
            if i:
                t = t if not np.isfinite(top) or t < top or close[i - 1] > top else top
                b = b if not np.isfinite(bottom) or b > bottom or close[i - 1] < bottom else bottom
                side[i] = (-1 if close[i] < b else 1) if side[i - 1] == 1 else (1 if close[i] > t else -1)
            top, bottom = t, b
            line[i] = b if side[i] == 1 and i else t
        return g[["symbol", "session", "idx"]].assign(supertrend=line, st_side=side)

    return _by_symbol(df, walk, "supertrend double, st_side long", ("high", "low", "close", "atr"))
