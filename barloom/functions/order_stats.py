"""Ranks and quantiles of a value within its symbol's last sessions, one Arrow pass for all of them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from .frames import AT, BY

#: Sessions whose windows are laid out at once: memory is this times the widest window.
AT_ONCE = 4096


class Rank(NamedTuple):
    """Where the current value of ``column`` stands among its last ``n`` sessions' values, as a share.

    ``average`` is the mean rank of ties over the count, ``max`` the share of
    values at or below the current one. Null below ``need`` values.
    """
    column: str
    n: int
    need: int | None = None
    ties: str = "average"

    def of(self, windows: np.ndarray, now: np.ndarray) -> np.ndarray:
        held = (~np.isnan(windows)).sum(axis=1)
        lower, equal = (windows < now[:, None]).sum(axis=1), (windows == now[:, None]).sum(axis=1)
        place = lower + (equal + 1) / 2 if self.ties == "average" else lower + equal
        ok = ~np.isnan(now) & (held >= (self.need or self.n))
        return np.where(ok, place / np.maximum(held, 1), np.nan)


class Quantile(NamedTuple):
    """The ``q`` quantile of ``column`` over its last ``n`` sessions, between neighbours in proportion; null below ``need`` values."""
    column: str
    q: float
    n: int
    need: int | None = None

    def of(self, windows: np.ndarray, now: np.ndarray) -> np.ndarray:
        ordered = np.sort(windows, axis=1)  # absent values last
        held = (~np.isnan(windows)).sum(axis=1)
        at = self.q * np.maximum(held - 1, 0)
        low = np.floor(at).astype(np.int64)
        rows = np.arange(len(windows))
        a, b = ordered[rows, low], ordered[rows, np.minimum(low + 1, np.maximum(held - 1, 0))]
        return np.where(held >= (self.need or self.n), a + (b - a) * (at - low), np.nan)


def _over_windows(values: np.ndarray, stats: dict[str, Rank | Quantile], n: int) -> dict[str, np.ndarray]:
    """Each statistic at each session of ``values``, a value or NaN per session; all have windows of ``n``."""
    padded = np.concatenate((np.full(n - 1, np.nan), values))
    out = {name: np.empty(len(values)) for name in stats}
    for k in range(0, len(values), AT_ONCE):
        now = values[k:k + AT_ONCE]
        windows = np.lib.stride_tricks.sliding_window_view(padded[k:k + len(now) + n - 1], n)
        for name, stat in stats.items():
            out[name][k:k + len(now)] = stat.of(windows, now)
    return out


def with_order_stats(df: DataFrame, stats: dict[str, Rank | Quantile], by=BY, at=AT) -> DataFrame:
    """``df`` with one column per statistic. A session without a row is an empty place of every window.

    A symbol's rows are one group, which its number of sessions bounds; a window
    is never copied per row into the plan.
    """
    keys = [by] if isinstance(by, str) else list(by)
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in stats]])

    def extend(group: pa.Table) -> pa.Table:
        where = group.column(at).to_numpy().astype(np.int64)
        first = int(where.min())
        added = {}
        for column, n in sorted({(s.column, s.n) for s in stats.values()}):
            cells = np.full(int(where.max()) - first + 1, np.nan)
            cells[where - first] = pc.cast(group.column(column), pa.float64()).to_numpy(zero_copy_only=False)
            same = {name: s for name, s in stats.items() if (s.column, s.n) == (column, n)}
            added |= {name: v[where - first] for name, v in _over_windows(cells, same, n).items()}
        for name in stats:
            group = group.append_column(name, pa.array(added[name], pa.float64(), mask=np.isnan(added[name])))
        return group

    return df.groupBy(*keys).applyInArrow(extend, schema)
