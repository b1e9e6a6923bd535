"""Column helpers shared by the operators: null discipline, safe ratios, text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The exchange's minimum tick and the words that mean "no value".
MIN_TICK = 0.01
ABSENT_WORDS = ("", "-", "na", "n/a", "nan", "null", "none")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and both infinities become NULL, the only absent marker used here."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def above(c, floor: float = 0.0) -> Column:
    """The value when it exceeds ``floor``, else NULL (a divisor guard)."""
    c = col(c)
    return F.when(c > floor, c)


def price(c) -> Column:
    """A price used as divisor: at or under one tick it is not a price."""
    return above(c, MIN_TICK)


def ratio(num, den) -> Column:
    """num / den with a zero or missing divisor giving NULL."""
    den = col(den)
    return col(num) / F.when(den != 0, den)


def pct_of(num, den) -> Column:
    return 100.0 * ratio(num, den)


def truth(c) -> Column:
    """A comparison with NULL counts as false, so unknown never raises a flag."""
    return F.coalesce(c, F.lit(False))


def r6(c, name: str | None = None) -> Column:
    """Six decimals, half up on the scaled double (no decimal-string detour)."""
    out = F.floor(col(c) * 1e6 + 0.5) / 1e6
    return out.alias(name) if name else out


def as_text(c) -> Column:
    """Trimmed text, or NULL for the words feeds use to say nothing."""
    t = F.trim(col(c))
    return F.when(~F.lower(t).isin(*ABSENT_WORDS), t)


def as_double(c) -> Column:
    """Text to double; separators dropped, junk and non-finite become NULL."""
    return finite(F.regexp_replace(as_text(c), ",", "").try_cast("double"))


def base_symbol(c) -> Column:
    """Text before the first dot, upper-cased."""
    return F.upper(F.split(F.trim(col(c)), r"\.")[0])


def all_of(preds) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(preds) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def first_reason(rules) -> Column:
    """Name of the first rule that fires, in order; NULL when none does."""
    return F.coalesce(*[F.when(truth(p), F.lit(n)) for n, p in rules])


def first_timestamp(cols, formats) -> Column:
    """First field, then first format, that yields a timestamp."""
    return F.coalesce(*[F.try_to_timestamp(as_text(c), F.lit(f)) for c in cols for f in formats])
