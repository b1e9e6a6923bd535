"""Window frames measured in panel sessions.

A panel is stored sparse: one row per (symbol, session) that traded, with
``idx``, the position of the session in the calendar. Frames are RANGE frames
over ``idx``, so a session in which a symbol did not trade takes up its place
in the window exactly as an empty cell of a dense matrix would - without ever
materialising that cell. "Count gates" then give NULL unless enough sessions of
the frame hold a value.

Every frame of a symbol shares one partitioning and one ordering, so Spark
plans a single exchange and a single sort for any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from .scalars import col

BY, AT = "symbol", "idx"


def _keys(by):
    return [by] if isinstance(by, str) else list(by)


def ordered(by=BY, at=AT) -> WindowSpec:
    return Window.partitionBy(*_keys(by)).orderBy(at)


def last_n(n: int, by=BY, at=AT) -> WindowSpec:
    """The current session and the n-1 before it."""
    return ordered(by, at).rangeBetween(-(n - 1), 0)


def prior_n(n: int, by=BY, at=AT) -> WindowSpec:
    """The n sessions before the current one, which stays outside."""
    return ordered(by, at).rangeBetween(-n, -1)


def around(w: int, by=BY, at=AT) -> WindowSpec:
    return ordered(by, at).rangeBetween(-w, w)


def so_far(by=BY, at=AT) -> WindowSpec:
    return ordered(by, at).rowsBetween(Window.unboundedPreceding, 0)


def before(by=BY, at=AT) -> WindowSpec:
    return ordered(by, at).rowsBetween(Window.unboundedPreceding, -1)


def whole(by=BY) -> WindowSpec:
    return Window.partitionBy(*_keys(by))


def shift(c, n: int = 1, by=BY, at=AT) -> Column:
    """Value exactly n sessions back; NULL if that session is a gap."""
    return F.max(col(c)).over(ordered(by, at).rangeBetween(-n, -n))


def gated(agg, c, n: int, frame: WindowSpec, need: int | None = None) -> Column:
    """agg(c) over the frame, NULL unless it holds at least ``need`` values."""
    c = col(c)
    return F.when(F.count(c).over(frame) >= (n if need is None else need), agg(c).over(frame))


def sma(c, n: int, **kw) -> Column:
    return gated(F.avg, c, n, last_n(n, **kw))


def rolling(agg, c, n: int, need: int | None = None, **kw) -> Column:
    return gated(agg, c, n, last_n(n, **kw), need)


def rolling_prior(agg, c, n: int, need: int | None = None, **kw) -> Column:
    return gated(agg, c, n, prior_n(n, **kw), need)
