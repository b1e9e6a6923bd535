"""Outcomes of entries: stop, target and time barriers.

A stop wins over a target on a bar that touches both. Scale unit of everything
here is the entry; each looks only at the ``hold`` sessions after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import frames as W
from ..functions.scalars import truth

# Fixed value: minimum tick.
TICK = 0.01


def _walls(entry, stop_pct: float, rr: float):
    return entry * (1 - stop_pct / 100.0), entry * (1 + rr * stop_pct / 100.0)


def lattice(panel: DataFrame, grid: list[dict], by=W.BY, at=W.AT, end: Column | None = None,
            keep=("session",), optimistic: bool = False) -> DataFrame:
    """R and exit position of an entry at every close, for each parameter set.

    ``grid`` rows hold ``stop_pct``, ``rr`` and ``hold``. The bars ahead are read
    once per entry, over the longest hold; parameters are evaluated on that
    window before anything is multiplied out, so a sweep costs one shuffle.
    A timeout is marked to the close of the last session and is dropped if that
    session has no close.
    """
    keys = [by] if isinstance(by, str) else list(by)
    longest = max(g["hold"] for g in grid)
    ahead = W.ordered(by, at).rangeBetween(1, longest)
    end = end if end is not None else panel.agg(F.max(at)).scalar()
    rows = (panel.withColumn("__end", end)
            .withColumn("__seen", F.collect_list(F.struct(F.col(at).alias("p"), "high", "low", "close")).over(ahead))
            .where((F.col("close") > 0) & (F.col(at) < F.col("__end"))))

    def outcome(g):
        stop, take = _walls(F.col("close"), g["stop_pct"], g["rr"])
        last = F.least(F.col(at) + g["hold"], F.col("__end"))
        touch = F.get(F.filter("__seen", lambda b: (b["p"] <= last)
                               & ((b["low"] <= stop) | (b["high"] >= take))), 0)
        final = F.get(F.filter("__seen", lambda b: b["p"] == last), 0)["close"]
        timed = (final - F.col("close")) / (F.col("close") * g["stop_pct"] / 100.0)
        hit_stop, hit_take = touch["low"] <= stop, touch["high"] >= take
        stopped = (hit_stop & ~hit_take) if optimistic else hit_stop
        r = F.when(touch.isNull(), timed).when(stopped, -1.0).otherwise(float(g["rr"]))
        how = F.when(touch.isNull(), "time").when(stopped, "stop").otherwise("target")
        return F.struct(F.lit(float(g["stop_pct"])).alias("stop_pct"), F.lit(float(g["rr"])).alias("rr"),
                        F.lit(int(g["hold"])).alias("hold"), r.alias("r"),
                        F.coalesce(touch["p"], last).alias("exit_at"), how.alias("how"))

    cols = list(dict.fromkeys([*keys, *keep, at]))
    return (rows.select(*cols, F.explode(F.array(*[outcome(g) for g in grid])).alias("o"))
            .select(*cols, "o.*").where(F.col("r").isNotNull()))


def session_lattice(bars: DataFrame, grid: list[dict], optimistic: bool = False) -> DataFrame:
    """Intraday form: every bar of a session is an entry, nothing is held over.

    A timeout always resolves here (the session's last bar exists) and scores 0R
    in ``session_summary``.
    """
    by = ("symbol", "session")
    n = bars.withColumn("bar", F.row_number().over(Window.partitionBy(*by).orderBy("bar_ts")))
    return lattice(n, grid, by=by, at="bar", end=F.max("bar").over(Window.partitionBy(*by)),
                   keep=(), optimistic=optimistic)


# Fixed value: statutory round trip in percent.
STATUTORY_PCT = 0.1222


def session_summary(lat: DataFrame, keys=("stop_pct", "rr", "hold"), slippage_pct: float = 0.3) -> DataFrame:
    g = lat.groupBy(*keys).agg(F.count_if(F.col("how") == "target").alias("target"),
                               F.count_if(F.col("how") == "stop").alias("stopped"),
                               F.count_if(F.col("how") == "time").alias("timed_out"))
    n = F.col("target") + F.col("stopped") + F.col("timed_out")
    g = g.withColumns({"trades": n, "win_rate": F.col("target") / n,
                       "gross_r": (F.col("target") * F.col("rr") - F.col("stopped")) / n,
                       "cost_r": (STATUTORY_PCT + slippage_pct) / F.col("stop_pct")})
    cost = F.col("cost_r")
    return g.withColumns({"net_r": F.col("gross_r") - cost,
                          "required_round_trip_pct": F.col("gross_r") * F.col("stop_pct"),
                          "breakeven_win_rate": (1.0 + cost) / (1.0 + F.col("rr"))})


def sequential(signals: DataFrame, keys, at: str = "idx", exit_at: str = "exit_at") -> DataFrame:
    """Non-overlapping trades: an entry counts only after the last exit.

    One fold per key over that key's signals in time order; a key has at most
    one signal per session.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in signals.columns if c not in (*keys, at, exit_at)]
    item = F.struct(at, exit_at, *rest)
    packed = signals.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    start = F.struct(F.lit(-1).cast("long").alias("busy"), F.slice("xs", 1, 0).alias("taken"))

    def step(acc, x):
        return F.when(x[at] > acc["busy"], F.struct(
            x[exit_at].cast("long").alias("busy"),
            F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    return (packed.select(*keys, F.explode(F.aggregate("xs", start, step, lambda a: a["taken"])).alias("t"))
            .select(*keys, "t.*"))


def sequential_sums(signals: DataFrame, keys, at: str = "idx", exit_at: str = "exit_at") -> DataFrame:
    """Sum and count of the trades ``sequential`` keeps, without listing them."""
    packed = signals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, exit_at, "r"))).alias("xs"))
    start = F.struct(F.lit(-1).cast("long").alias("busy"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        return F.when(x[at] > acc["busy"], F.struct(
            x[exit_at].cast("long").alias("busy"), (acc["s"] + x["r"]).alias("s"),
            (acc["n"] + 1).alias("n"))).otherwise(acc)

    return packed.select(*keys, F.aggregate("xs", start, step).alias("a")).select(
        *keys, F.col("a.s").alias("sum_r"), F.col("a.n").alias("trades"))


def simulate(signals: DataFrame, bars: DataFrame, horizon: int = 5, min_risk_pct: float | None = None,
             exit_level: str | None = None) -> DataFrame:
    """Enter each signal at the open of the symbol's next bar and follow it.

    ``signals``: sid, symbol, decided_on, stop, target, qty. A sort of bars and
    signals by date finds the entry bar; the signal then meets its ``horizon``
    bars through an equality join on (symbol, bar number), so no symbol's
    history is paired with all its signals. A refused signal keeps its reason.
    """
    num = Window.partitionBy("symbol").orderBy("session")
    extra = [exit_level] if exit_level else []
    b = bars.select("symbol", "session", "open", "high", "low", "close", *extra,
                    F.row_number().over(num).alias("pos"))
    # one row per symbol and day on either side, however many signals share a day
    marks = (b.select("symbol", F.col("session").alias("at"), F.lit(0).alias("kind"), "pos")
             .unionByName(signals.select("symbol", F.col("decided_on").alias("at"), F.lit(1).alias("kind"),
                                         F.lit(None).cast("int").alias("pos")).distinct()))
    seen = Window.partitionBy("symbol").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    entry = (marks.withColumn("entry_pos", F.coalesce(F.max("pos").over(seen), F.lit(0)) + 1)
             .where("kind = 1").select("symbol", F.col("at").alias("decided_on"), "entry_pos"))
    sig = signals.select("sid", "symbol", "decided_on", "stop", "target", "qty")
    steps = (sig.join(entry, ["symbol", "decided_on"])
             .withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
             .withColumn("pos", F.col("entry_pos") + F.col("n") - 1))
    met = steps.join(b, ["symbol", "pos"], "left")
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    stop, target = F.col("stop"), F.col("target")
    later = F.col("n") > 1

    def ev(price, reason, gapped=False, ambiguous=False):
        return F.struct(price.alias("price"), F.lit(reason).alias("reason"),
                        F.lit(gapped).alias("gapped"), F.lit(ambiguous).alias("ambiguous"))

    event = (F.when(truth(later & (o <= stop)), ev(o, "stop", gapped=True))
             .when(truth(later & (o >= target)), ev(o, "target", gapped=True))
             .when(truth((l <= stop) & (h >= target)), ev(stop, "stop", ambiguous=True))
             .when(truth(l <= stop), ev(stop, "stop"))
             .when(truth(h >= target), ev(target, "target")))
    if exit_level:
        event = F.coalesce(event, F.when(truth(c < F.col(exit_level)), ev(c, "strategy_exit")))
    met = met.withColumn("ev", event)
    keys = ("sid", "symbol", "decided_on", "stop", "target", "qty")
    g = met.groupBy(*keys).agg(
        F.min(F.when(F.col("n") == 1, F.struct("session", "open"))).alias("first"),
        F.min(F.when(F.col("ev").isNotNull(), F.struct("n", "session", "ev"))).alias("hit"),
        F.max(F.when(c.isNotNull(), F.struct("n", "session", "close"))).alias("last"))
    e = F.col("first.open")
    risk_pct = 100.0 * (e - stop) / F.when(e > 0, e)
    refused = (F.when(F.coalesce(F.col("qty"), F.lit(0)) <= 0, "nothing to buy")
               .when(F.col("first.session").isNull(), "no later session")
               .when(~truth(e > 0), "no opening price")
               .when(e - stop < TICK - 1e-9, "opened at the stop")
               .when(truth(risk_pct < min_risk_pct) if min_risk_pct is not None else F.lit(False),
                     "risk too small for its slippage")
               .when(truth(e >= target), "opened beyond the target"))
    taken = F.col("refused").isNull()
    g = g.withColumn("refused", refused)
    return g.select(
        *keys, "refused",
        *[F.when(taken, v).alias(k) for k, v in {
            "entry_date": F.col("first.session"), "entry_price": e,
            "exit_date": F.coalesce("hit.session", "last.session"),
            "exit_price": F.coalesce("hit.ev.price", "last.close"),
            "exit_reason": F.coalesce("hit.ev.reason", F.lit("time")),
            "bars_held": F.coalesce("hit.n", "last.n"),
            "gapped": F.coalesce("hit.ev.gapped", F.lit(False)),
            "ambiguous": F.coalesce("hit.ev.ambiguous", F.lit(False))}.items()],
    ).withColumns({
        "gross_pnl": (F.col("exit_price") - F.col("entry_price")) * F.col("qty"),
        "r_multiple": (F.col("exit_price") - F.col("entry_price")) / (F.col("entry_price") - stop)})
