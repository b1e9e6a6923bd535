"""SQL fragments of the DuckDB side: the same bindings, stated independently.

The SQL builds the full session-by-symbol matrix and uses ROWS frames on it,
where the Spark side keeps the panel sparse and uses RANGE frames.
"""

from __future__ import annotations

KEY = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _bars(keys: str, src: str, grain: str, where: str = "true") -> str:
    names = ", ".join(k.split(" AS ")[-1] for k in keys.split(" | "))
    cols = keys.replace(" | ", ", ")
    return f"""SELECT {names}, first(price ORDER BY {KEY}) AS open, max(price) AS high,
        min(price) AS low, last(price ORDER BY {KEY}) AS close, sum(l_quantity) AS volume,
        sum(l_extendedprice) AS turnover, count(*) AS trades
      FROM (SELECT *, l_extendedprice / l_quantity AS price,
                   CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS session, {cols}
            FROM {src} WHERE {where}) t GROUP BY ALL"""


def supp(grain: str = "month", name: str = "bars0", where: str = "true") -> str:
    return f"{name} AS (" + _bars("'S' || l_suppkey AS symbol", "lineitem", grain, where).replace(
        "SELECT symbol,", "SELECT symbol, session,", 1) + ")"


def brand(grain: str = "month", name: str = "bars0") -> str:
    return f"{name} AS (" + _bars("p_brand AS symbol", "lineitem JOIN part ON l_partkey = p_partkey",
                                  grain).replace("SELECT symbol,", "SELECT symbol, session,", 1) + ")"


def calm(grain: str = "") -> str:
    return """wks AS (SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS wk,
        sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume, sum(l_extendedprice) AS turnover, count(*) AS trades
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    bars0 AS (SELECT symbol, CAST(date_trunc('month', wk) AS DATE) AS session, arg_min(price, wk) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, wk) AS close, sum(volume) AS volume, sum(turnover) AS turnover,
        CAST(sum(trades) AS BIGINT) AS trades FROM wks GROUP BY ALL)"""


def series(grain: str = "month", name: str = "bars0") -> str:
    return f"{name} AS (" + _bars("'S' || l_suppkey AS symbol | l_returnflag AS series", "lineitem",
                                  grain).replace("SELECT symbol,", "SELECT session, symbol,", 1) + ")"


CAL = """cal AS (SELECT session, CAST(row_number() OVER (ORDER BY session) - 1 AS INTEGER) AS idx
    FROM (SELECT DISTINCT session FROM bars0))"""
BARS = "bars AS (SELECT b.*, c.idx FROM bars0 b JOIN cal c USING (session))"
DENSE = """dense AS (SELECT s.symbol, c.session, c.idx, b.open, b.high, b.low, b.close, b.volume,
        b.turnover, b.trades
    FROM (SELECT DISTINCT symbol FROM bars0) s CROSS JOIN cal c
    LEFT JOIN bars0 b ON b.symbol = s.symbol AND b.session = c.session)"""

HOURS = """hours AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS session,
        date_trunc('hour', ts) AS bar_ts, first(value ORDER BY ts, event_id) AS open,
        max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
        CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY ALL)"""

IND = """ind AS (SELECT 'S' || s_suppkey AS symbol, r_name AS industry, n_name AS nation
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def panel(grain: str = "month", kind=supp) -> list[str]:
    return [kind(grain), CAL, BARS, DENSE]


def sql(body: str, *ctes) -> str:
    parts = []

    def flatten(c):
        if isinstance(c, str):
            parts.append(c)
        else:
            for x in c:
                flatten(x)

    flatten(ctes)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r(expr: str, name: str) -> str:
    """Six decimals, half up on the scaled double."""
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6 AS {name}"


def day(expr: str, name: str = "session") -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {name}"


def ewm(src: str, out: str, **specs) -> str:
    """Recursive smoothing, one row at a time over the dense rows of a symbol.

    ``specs``: name = (expression, alpha). A missing value keeps the level and
    lets its weight decay until the next value arrives.
    """
    xs = ", ".join(f"{e} AS x_{n}" for n, (e, _) in specs.items())
    start = ", ".join(f"CAST(x_{n} AS DOUBLE) AS {n}, CAST(1 AS DOUBLE) AS w_{n}" for n in specs)
    step = ", ".join(
        f"""CASE WHEN s.x_{n} IS NULL THEN f.{n} WHEN f.{n} IS NULL THEN s.x_{n}
            ELSE (f.w_{n} * (1 - {a}) * f.{n} + {a} * s.x_{n}) / (f.w_{n} * (1 - {a}) + {a}) END,
            CASE WHEN s.x_{n} IS NULL THEN f.w_{n} * (1 - {a}) ELSE 1.0 END"""
        for n, (_, a) in specs.items())
    return f"""{out} AS (
      WITH RECURSIVE seq AS (SELECT symbol, idx, {xs} FROM {src}),
      f AS (SELECT symbol, idx, {start} FROM seq WHERE idx = 0
            UNION ALL SELECT s.symbol, s.idx, {step}
            FROM f JOIN seq s ON s.symbol = f.symbol AND s.idx = f.idx + 1)
      SELECT symbol, idx, {", ".join(specs)} FROM f)"""
