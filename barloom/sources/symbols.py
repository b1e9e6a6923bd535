"""Symbol dialects: EX:BASE, BASE.NS, BASE.BO, BASE.NSE to one canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted base pattern, suffixes and how each dialect writes them.
BASE_PATTERN = r"^[A-Z0-9][A-Z0-9&-]{0,29}$"
SUFFIXES = {"NS": "NSE", "NSE": "NSE", "BO": "BSE", "BSE": "BSE"}
DIALECTS = {"yahoo": {"NSE": ".NS", "BSE": ".BO"}, "suffix": {"NSE": ".NSE", "BSE": ".BSE"}}


def _lookup(m: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), key)


def raw_text(raw: str) -> str:
    return f"upper(trim(`{raw}`))"


def parse(df: DataFrame, raw: str, default: str = "NSE") -> DataFrame:
    """Adds ``base`` and ``exchange``; both NULL for a refused symbol."""
    u = F.upper(F.trim(F.col(raw)))
    pre, dot = F.instr(u, ":") > 0, F.instr(u, ".") > 0
    # one separator counts, the first ":" or else the last "."; the whole rest must be a base
    exch = (F.when(pre, _lookup({"NSE": "NSE", "BSE": "BSE"}, F.substring_index(u, ":", 1)))
            .when(dot, _lookup(SUFFIXES, F.substring_index(u, ".", -1))).otherwise(default))
    base = F.when(pre, F.expr(f"substr({raw_text(raw)}, instr({raw_text(raw)}, ':') + 1)")).when(dot, F.regexp_replace(u, r"\.[^.]*$", "")).otherwise(u)
    ok = exch.isNotNull() & base.rlike(BASE_PATTERN)
    return df.withColumns({"base": F.when(ok, base), "exchange": F.when(ok, exch)})


def translate(dialect: str) -> Column:
    if dialect == "prefix":
        return F.concat("exchange", F.lit(":"), "base")
    return F.concat("base", _lookup(DIALECTS[dialect], F.col("exchange")))


def refused(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("base").isNull())
