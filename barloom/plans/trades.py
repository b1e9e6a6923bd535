"""Outcome lattices, selections, simulated trades, replays and their metrics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import frames as W
from ..functions.scalars import r6
from ..operators import costs, features as ft, metrics, outcomes as oc, presets, ranking, resample, setups
from . import tables as t
from .indicators import BENCH, BW, LAG, SM, gate, layer, prior, rs, show
from .oracle import HOURS, brand, day, panel as P, r, sql, supp
from .registry import query
from .scans import dated, rounded
from .signals import AS_OF, bench_of, feature_sql, features_at, score_sql

GRID = [dict(stop_pct=5.0, rr=2.0, hold=6), dict(stop_pct=10.0, rr=1.5, hold=12)]


def grid_sql(grid, name="grid") -> str:
    vals = ", ".join(f"(CAST({g['stop_pct']} AS DOUBLE), CAST({g['rr']} AS DOUBLE), {g['hold']})" for g in grid)
    return f"{name} AS (SELECT * FROM (VALUES {vals}) g(stop_pct, rr, hold))"


def lattice_sql(src="dense", key="symbol", at="idx", end="(SELECT max(idx) FROM cal)", out="lat",
                optimistic=False, extra="") -> list[str]:
    on = " AND ".join(f"f.{k} = e.{k}" for k in key.split(", "))
    ks = ", ".join(f"e.{k}" for k in key.split(", "))
    hit = "h.low <= e.s AND NOT h.high >= e.k" if optimistic else "h.low <= e.s"
    return [
        f"""ent AS (SELECT {key}, {extra} {at} AS at_, close, stop_pct, rr, hold, close * (1 - stop_pct / 100.0) AS s,
              close * (1 + rr * stop_pct / 100.0) AS k, least({at} + hold, {end}) AS last_
            FROM {src} d, grid WHERE close > 0 AND {at} < {end})""",
        f"""tch AS (SELECT {ks}, e.at_, e.stop_pct, e.rr, e.hold, min(f.{at}) AS hit FROM ent e JOIN {src} f
              ON {on} AND f.{at} BETWEEN e.at_ + 1 AND e.last_ AND (f.low <= e.s OR f.high >= e.k) GROUP BY ALL)""",
        f"""{out} AS (SELECT {ks}, {extra.replace('session', 'e.session')} e.at_ AS idx, e.stop_pct, e.rr, e.hold,
              coalesce(hit, last_) AS exit_at, CASE WHEN hit IS NULL THEN 'time' WHEN {hit} THEN 'stop' ELSE 'target' END AS how,
              CASE WHEN hit IS NULL THEN (z.close - e.close) / (e.close * e.stop_pct / 100.0) WHEN {hit} THEN -1.0 ELSE e.rr END AS r
            FROM ent e LEFT JOIN tch USING ({key}, at_, stop_pct, rr, hold)
            LEFT JOIN {src} h ON {on.replace('f.', 'h.')} AND h.{at} = hit
            LEFT JOIN {src} z ON {on.replace('f.', 'z.')} AND z.{at} = last_
            WHERE hit IS NOT NULL OR z.close IS NOT NULL)"""]


LAT_OUT = f"symbol, {day('session')}, stop_pct, rr, hold, {r('r', 'r')}, exit_at, how"


@query("2.6.2 2.13.2", sql(f"SELECT {LAT_OUT} FROM lat", SM, grid_sql(GRID), lattice_sql(extra="session,")))
def outcome_lattice(spark, sf):
    lat = oc.lattice(t.bars(spark, sf), GRID)
    return show(lat, "stop_pct", "rr", "hold", "r", "exit_at", "how")


BARNO = ["bn AS (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY bar_ts) AS bar FROM hours)",
         "n AS (SELECT *, max(bar) OVER (PARTITION BY symbol, session) AS last_bar FROM bn)"]
IGRID = [dict(stop_pct=float(s), rr=float(q), hold=73) for s in (20, 40, 60, 80) for q in (1.0, 1.5, 2.0, 2.5, 3.0)]


def frontier_sql(optimistic=False) -> str:
    return sql(f"""SELECT stop_pct, rr, hold, count(*) FILTER (how = 'target') AS target, count(*) FILTER (how = 'stop') AS stopped,
        count(*) FILTER (how = 'time') AS timed_out, count(*) AS trades, {r("count(*) FILTER (how = 'target') / count(*)", 'win_rate')},
        {r("(count(*) FILTER (how = 'target') * rr - count(*) FILTER (how = 'stop')) / count(*)", 'gross_r')},
        {r("(0.1222 + 0.3) / stop_pct", 'cost_r')},
        {r("(count(*) FILTER (how = 'target') * rr - count(*) FILTER (how = 'stop')) / count(*) - (0.1222 + 0.3) / stop_pct", 'net_r')},
        {r("(count(*) FILTER (how = 'target') * rr - count(*) FILTER (how = 'stop')) / count(*) * stop_pct", 'required_round_trip_pct')},
        {r("(1 + (0.1222 + 0.3) / stop_pct) / (1 + rr)", 'breakeven_win_rate')} FROM lat GROUP BY stop_pct, rr, hold""",
        HOURS, BARNO, grid_sql(IGRID), lattice_sql("n", "symbol, session", "bar", "last_bar", optimistic=optimistic))


def frontier(spark, sf, optimistic):
    lat = oc.session_lattice(t.hour_bars(spark, sf), IGRID, optimistic)
    s = oc.session_summary(lat)
    return rounded(s, "win_rate", "gross_r", "cost_r", "net_r", "required_round_trip_pct", "breakeven_win_rate")


@query("2.6.6 2.4.19 2.6.33", frontier_sql())
def intraday_frontier(spark, sf):
    return frontier(spark, sf, False)


@query("2.6.6 2.4.19", frontier_sql(True))
def intraday_frontier_optimistic(spark, sf):
    return frontier(spark, sf, True)


XGRID = [dict(stop_pct=40.0, rr=2.0, hold=h) for h in (14, 35, 70)]
RUNNING = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS bar, count(*) OVER (PARTITION BY symbol) AS last_bar FROM hours)"


@query("2.6.34", sql(f"SELECT hold, how, count(*) AS trades, {r('avg(r)', 'mean_r')} FROM lat GROUP BY ALL", HOURS, RUNNING,
                     grid_sql(XGRID), lattice_sql("n", "symbol", "bar", "last_bar")))
def held_across_sessions(spark, sf):
    h = t.hour_bars(spark, sf).withColumn("bar", F.row_number().over(Window.partitionBy("symbol").orderBy("bar_ts")))
    lat = oc.lattice(h, XGRID, by="symbol", at="bar", end=F.max("bar").over(Window.partitionBy("symbol")), keep=())
    return rounded(lat.groupBy("hold", "how").agg(F.count(F.lit(1)).alias("trades"), F.avg("r").alias("mean_r")), "mean_r")


def seq_sql(src: str, out: str, keys="symbol") -> list[str]:
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    ka = ", ".join(f"a.{k}" for k in keys.split(", "))
    return [f"nx AS (SELECT {ka}, a.idx, min(b.idx) AS nxt FROM {src} a JOIN {src} b ON {on('a', 'b')} AND b.idx > a.exit_at GROUP BY ALL)",
            f"""picked AS (WITH RECURSIVE f AS (SELECT {keys}, min(idx) AS idx FROM {src} GROUP BY {keys}
                  UNION ALL SELECT {ka}, a.nxt FROM f JOIN nx a ON {on('f', 'a')} AND f.idx = a.idx) SELECT * FROM f)""",
            f"{out} AS (SELECT s.* FROM {src} s JOIN picked USING ({keys}, idx))"]


DGRID = [dict(stop_pct=10.0, rr=2.0, hold=8)]
BREAK = layer("sig", f"coalesce(close > {gate('max', 'high', 10, prior(10))}, false) AS fires")
BRK_RULE = presets.Rule("breakout_10", (presets.Ind("hi", "donchian", 10, component="upper"),),
                        (presets.Cond("close", "gt", "hi"),), 10.0, 20.0)
WEEK_LAT = [BW, grid_sql(DGRID), lattice_sql(extra="session,"), BREAK]


def breakouts(b):
    return presets.signals(b, BRK_RULE).where("signal").select("symbol", "session", "idx")


@query("2.6.3 2.5.37", sql(f"SELECT symbol, {day('session')}, exit_at, {r('r', 'r')} FROM seq", WEEK_LAT,
       "sg AS (SELECT lat.* FROM lat JOIN sig USING (symbol, idx) WHERE fires)", seq_sql("sg", "seq")))
def sequential_trades(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    sg = breakouts(b).join(oc.lattice(b, DGRID).drop("session"), ["symbol", "idx"])
    return show(oc.sequential(sg.select("symbol", "idx", "exit_at", "session", "r"), "symbol"), "exit_at", "r")


WF_SQL = ["nn AS (SELECT count(*) AS n FROM cal)",
          "win AS (SELECT i AS w, CAST(floor(n * i / 4) AS BIGINT) AS lo, CAST(floor(n * (i + 1) / 4) AS BIGINT) AS hi FROM nn, range(4) g(i))",
          """sg AS (SELECT lat.*, w FROM lat JOIN sig USING (symbol, idx) JOIN win ON lat.idx >= lo AND lat.idx < hi - 8 - 1 AND exit_at < hi
               WHERE fires)""", *seq_sql("sg", "seq", "symbol, w")]


def windowed_trades(b, sessions_n):
    """Sequential breakout trades resolved inside their own walk-forward window."""
    sg = (breakouts(b).join(oc.lattice(b, DGRID).drop("session"), ["symbol", "idx"])
          .withColumn("g", F.explode(metrics.linspace_windows(sessions_n, 4)))
          .where((F.col("idx") >= F.col("g.lo")) & (F.col("idx") < F.col("g.hi") - 9) & (F.col("exit_at") < F.col("g.hi")))
          .select("symbol", F.col("g.window").alias("window"), "idx", "exit_at", "session", "r"))
    return oc.sequential(sg, ["symbol", "window"])


def n_sessions(b):
    return b.agg(F.max("idx") + 1).scalar()


@query("2.6.5 2.4.14 2.4.15", sql(f"""SELECT CAST(w AS INTEGER) AS "window", trades, {r('net', 'net_r')}, {r('med', 'median_net_r')},
      {r('hit', 'target_hit_pct')}, CAST(trades >= 30 AS INTEGER) AS scored, CAST(trades >= 30 AND net > 0 AS INTEGER) AS positive FROM
      (SELECT w, count(*) AS trades, median(r - 0.05) AS med, 100.0 * avg(CASE WHEN abs(r - 2) < 1e-9 THEN 1.0 ELSE 0 END) AS hit FROM seq GROUP BY w)
      JOIN (SELECT w, avg(m) AS net FROM (SELECT w, strftime(session, '%Y-%m') AS mo, avg(r - 0.05) AS m FROM seq GROUP BY ALL) GROUP BY w) USING (w)""",
      WEEK_LAT, WF_SQL))
def preset_walk_forward(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    tr = windowed_trades(b, n_sessions(b)).withColumn("month", F.date_format("session", "yyyy-MM"))
    s = metrics.cohort_summary(tr, ["window"], "month", 2.0, 0.05)
    return rounded(s.withColumns({c: F.col(c).cast("int") for c in ("scored", "positive")}),
                   "net_r", "median_net_r", "target_hit_pct")


@query("2.4.13 2.4.14", sql(f"""SELECT count(*) FILTER (sc) AS scored, count(*) FILTER (sc AND net > 0) AS windows_positive,
      {r('avg(net) FILTER (sc)', 'pooled_net_r')}, CASE WHEN count(*) FILTER (sc) = 0 THEN 'sample too small'
        WHEN avg(net) FILTER (sc) > 0 AND count(*) FILTER (sc AND net > 0) = count(*) FILTER (sc) AND count(*) FILTER (sc) >= 3 THEN 'positive in every window'
        WHEN avg(net) FILTER (sc) > 0 THEN 'positive in part' ELSE 'no case' END AS verdict
      FROM (SELECT w, avg(m) AS net, sum(n) >= 30 AS sc FROM (SELECT w, strftime(session, '%Y-%m') AS mo, avg(r - 0.05) AS m, count(*) AS n
              FROM seq GROUP BY ALL) GROUP BY w)""", WEEK_LAT, WF_SQL))
def walk_forward_verdict(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    tr = windowed_trades(b, n_sessions(b)).withColumn("month", F.date_format("session", "yyyy-MM"))
    return rounded(metrics.pooled_verdict(metrics.cohort_summary(tr, ["window"], "month", 2.0, 0.05)), "pooled_net_r")


@query("2.4.15", sql(f"""SELECT strftime(session, '%Y-%m') AS month, count(*) AS trades, {r('avg(r)', 'gross_r')},
      {r('(avg(r) * 10.0 - 0.1222) * 50', 'breakeven_bps')} FROM seq GROUP BY ALL""", WEEK_LAT, WF_SQL))
def monthly_cohorts(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    tr = windowed_trades(b, n_sessions(b)).groupBy(F.date_format("session", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("trades"), F.avg("r").alias("gross_r"))
    return rounded(tr.withColumn("breakeven_bps", (F.col("gross_r") * 10.0 - 0.1222) * 50), "gross_r", "breakeven_bps")


PERM_SQL = [
    "m AS (SELECT symbol, count(*) AS m FROM sig WHERE fires GROUP BY symbol)",
    """moved AS (SELECT symbol, perm, idx FROM (SELECT symbol, m, perm, idx, row_number() OVER (PARTITION BY symbol, perm
            ORDER BY md5('7|' || perm || '|' || symbol || '|' || idx), idx) AS rn
          FROM m, (SELECT unnest(range(1, 41)) AS perm) p, (SELECT idx FROM cal) c) WHERE rn <= m)""",
    """sg AS (SELECT e.symbol, e.perm, e.idx, exit_at, r FROM (SELECT symbol, 0 AS perm, idx FROM sig WHERE fires UNION ALL
            SELECT * FROM moved) e JOIN lat USING (symbol, idx))""",
    *seq_sql("sg", "seq", "symbol, perm"),
    "runs AS (SELECT perm, avg(r) - 0.05 AS m, count(*) AS n FROM seq GROUP BY perm)"]


@query("2.6.4", sql(f"""SELECT {r('max(o)', 'observed')}, {r('avg(m) FILTER (perm > 0)', 'null_mean')},
      {r('stddev_pop(m) FILTER (perm > 0)', 'null_std')}, {r('(count(*) FILTER (perm > 0 AND m >= o) + 1) / (count(*) FILTER (perm > 0) + 1)', 'p_value')},
      count(*) FILTER (perm > 0) AS n_permutations, max(n) FILTER (perm = 0) AS n_trades,
      {r('100.0 * count(*) FILTER (perm > 0 AND m < o) / count(*) FILTER (perm > 0)', 'percentile')}
      FROM runs, (SELECT m AS o FROM runs WHERE perm = 0)""", WEEK_LAT, PERM_SQL))
def signal_timing_test(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    out = resample.timing_test(breakouts(b), oc.lattice(b, DGRID), n_sessions(b), cost_r=0.05, n_perm=40)
    return rounded(out, "observed", "null_mean", "null_std", "p_value", "percentile")


# ---- simulated trades ----------------------------------------------------

SIG_SQL = f"""sigs AS (SELECT symbol || '@' || idx AS sid, symbol, session AS decided_on, close * 0.6 AS stop, close * 1.5 AS target,
      CAST(floor(200000 / close) - 30 AS BIGINT) AS qty FROM (SELECT *, {gate('avg', 'volume', 5, prior(5))} AS vb FROM dense) WHERE volume > 1.3 * vb)"""


def sim_sql(sigs="sigs", horizon=5, level=None, floor=None, out="sim", src="bars0") -> list[str]:
    lvl = f"WHEN f.close < f.{level} THEN 'strategy_exit'" if level else ""
    lvp = f"WHEN f.close < f.{level} THEN f.close" if level else ""
    flr = f"WHEN 100 * (e.open - s.stop) / e.open < {floor} THEN 'risk too small for its slippage'" if floor else ""
    return [
        f"pb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS pos FROM {src})",
        f"ep AS (SELECT s.sid, min(b.pos) AS p0 FROM {sigs} s JOIN pb b ON b.symbol = s.symbol AND b.session > s.decided_on GROUP BY s.sid)",
        f"""st AS (SELECT s.sid, f.pos - p0 + 1 AS n, f.session, f.close, f.open,
              CASE WHEN f.pos > p0 AND f.open <= s.stop THEN 'gap_stop' WHEN f.pos > p0 AND f.open >= s.target THEN 'gap_target'
                WHEN f.low <= s.stop AND f.high >= s.target THEN 'both' WHEN f.low <= s.stop THEN 'stop' WHEN f.high >= s.target THEN 'target' {lvl} END AS ev,
              CASE WHEN f.pos > p0 AND f.open <= s.stop THEN f.open WHEN f.pos > p0 AND f.open >= s.target THEN f.open
                WHEN f.low <= s.stop THEN s.stop WHEN f.high >= s.target THEN s.target {lvp} END AS px
            FROM {sigs} s JOIN ep USING (sid) JOIN pb f ON f.symbol = s.symbol AND f.pos BETWEEN p0 AND p0 + {horizon - 1})""",
        "fh AS (SELECT sid, min(n) FILTER (ev IS NOT NULL) AS hn, max(n) AS ln FROM st GROUP BY sid)",
        f"""{out} AS (SELECT s.*, CASE WHEN s.qty <= 0 THEN 'nothing to buy' WHEN e.sid IS NULL THEN 'no later session'
              WHEN NOT coalesce(e.open > 0, false) THEN 'no opening price'
              WHEN e.open - s.stop < 0.01 - 1e-9 THEN 'opened at the stop' {flr}
              WHEN e.open >= s.target THEN 'opened beyond the target' END AS refused,
              e.session AS entry_date, e.open AS entry_price, x.session AS exit_date,
              CASE WHEN hn IS NULL THEN x.close ELSE x.px END AS exit_price,
              CASE WHEN hn IS NULL THEN 'time' WHEN x.ev = 'both' THEN 'stop' ELSE replace(x.ev, 'gap_', '') END AS exit_reason,
              coalesce(hn, ln) AS bars_held, coalesce(x.ev LIKE 'gap%', false) AS gapped, coalesce(x.ev = 'both', false) AS ambiguous
            FROM {sigs} s LEFT JOIN st e ON e.sid = s.sid AND e.n = 1 LEFT JOIN fh ON fh.sid = s.sid
            LEFT JOIN st x ON x.sid = s.sid AND x.n = coalesce(hn, ln))"""]


SIM_OUT = f"""sid, symbol, {day('decided_on', 'decided_on')}, refused, CASE WHEN refused IS NULL THEN strftime(entry_date, '%Y-%m-%d') END AS entry_date,
    {r('CASE WHEN refused IS NULL THEN entry_price END', 'entry_price')}, CASE WHEN refused IS NULL THEN strftime(exit_date, '%Y-%m-%d') END AS exit_date,
    {r('CASE WHEN refused IS NULL THEN exit_price END', 'exit_price')}, CASE WHEN refused IS NULL THEN exit_reason END AS exit_reason,
    CAST(CASE WHEN refused IS NULL THEN bars_held END AS DOUBLE) AS bars_held, CAST(CASE WHEN refused IS NULL THEN gapped END AS DOUBLE) AS gapped,
    CAST(CASE WHEN refused IS NULL THEN ambiguous END AS DOUBLE) AS ambiguous,
    {r('CASE WHEN refused IS NULL THEN (exit_price - entry_price) * qty END', 'gross_pnl')},
    {r('CASE WHEN refused IS NULL THEN (exit_price - entry_price) / (entry_price - stop) END', 'r_multiple')}"""


def volume_signals(b):
    """Long entries on volume well above the prior five sessions, fixed-percent barriers."""
    s = b.withColumn("vb", W.rolling_prior(F.avg, "volume", 5)).where(F.col("volume") > 1.3 * F.col("vb"))
    return s.select(F.concat("symbol", F.lit("@"), "idx").alias("sid"), "symbol", F.col("session").alias("decided_on"),
                    (F.col("close") * 0.6).alias("stop"), (F.col("close") * 1.5).alias("target"),
                    (F.floor(200000 / F.col("close")) - 30).alias("qty"))


def shown_sim(sim):
    sim = sim.withColumns({c: F.col(c).cast("double") for c in ("bars_held", "gapped", "ambiguous")})
    out = rounded(sim, "entry_price", "exit_price", "gross_pnl", "r_multiple").drop("stop", "target", "qty")
    return dated(out, "decided_on", "entry_date", "exit_date")


@query("2.6.1", sql(f"SELECT {SIM_OUT} FROM sim", SM, SIG_SQL, sim_sql()))
def simulated_trades(spark, sf):
    b = t.bars(spark, sf)
    return shown_sim(oc.simulate(volume_signals(b), b, 5))


@query("2.6.1 2.6.15", sql(f"SELECT {SIM_OUT} FROM sim", SM, SIG_SQL,
       f"bl AS (SELECT *, {gate('min', 'low', 10, prior(10))} AS lvl FROM dense)", "blx AS (SELECT * FROM bl WHERE close IS NOT NULL)",
       sim_sql(level="lvl", floor=5.0, src="blx", horizon=8)))
def simulated_trades_with_exit(spark, sf):
    b = t.bars(spark, sf)
    leveled = b.withColumn("lvl", W.rolling_prior(F.min, "low", 10))
    return shown_sim(oc.simulate(volume_signals(b), leveled, 8, min_risk_pct=5.0, exit_level="lvl"))


CM = costs.CostModel()
COST_E = f"(abs(entry_price * qty) * {CM.side_pct('buy') / 100 + CM.slippage_bps / 1e4!r} + abs(exit_price * qty) * {CM.side_pct('sell') / 100 + CM.slippage_bps / 1e4!r})"
TRADED = f"""tr AS (SELECT *, (exit_price - entry_price) * qty AS gross_pnl, (exit_price - entry_price) / (entry_price - stop) AS rm,
     {COST_E} AS cost, {COST_E} / (abs(entry_price - stop) * qty) AS cost_r FROM sim WHERE refused IS NULL)"""


def taken(spark, sf):
    b = t.bars(spark, sf)
    return metrics.with_costs(oc.simulate(volume_signals(b), b, 5).where("refused IS NULL"))


@query("2.4.9 2.6.13", sql(f"""SELECT count(*) AS trades, count(*) FILTER (rm > 0) AS wins, {r('100.0 * count(*) FILTER (rm > 0) / count(*)', 'win_rate')},
     {r('avg(rm)', 'expectancy_r')}, {r('avg(rm - cost_r)', 'expectancy_r_net')}, round(sum(rm), 3) AS total_r, round(sum(gross_pnl), 3) AS gross_pnl,
     round(sum(cost), 3) AS total_costs, round(sum(gross_pnl - cost), 3) AS net_pnl, count(*) FILTER (ambiguous) AS ambiguous,
     count(*) FILTER (gapped) AS gapped FROM tr""", SM, SIG_SQL, sim_sql(), TRADED))
def trade_summary(spark, sf):
    s = rounded(metrics.summary(taken(spark, sf)), "win_rate", "expectancy_r", "expectancy_r_net")
    return s.withColumns({c: F.round(c, 3) for c in ("total_r", "gross_pnl", "total_costs", "net_pnl")})


@query("2.4.9", sql(f"SELECT exit_reason, count(*) AS trades, {r('avg(rm)', 'mean_r')} FROM tr GROUP BY exit_reason", SM, SIG_SQL, sim_sql(), TRADED))
def trades_by_exit(spark, sf):
    return rounded(metrics.by_exit(taken(spark, sf)), "mean_r")


@query("2.4.10", sql(f"""SELECT {r('least(0, min(run - greatest(0, top)))', 'max_drawdown_r')} FROM (SELECT run, max(run) OVER (ORDER BY exit_date, symbol, sid) AS top
      FROM (SELECT *, sum(rm) OVER (ORDER BY exit_date, symbol, sid) AS run FROM tr))""", SM, SIG_SQL, sim_sql(), TRADED))
def max_drawdown_in_r(spark, sf):
    return rounded(metrics.max_drawdown_r(taken(spark, sf)), "max_drawdown_r")


@query("2.6.13 2.6.15", sql(f"""SELECT sid, {r('cost', 'cost')}, {r('cost_r', 'cost_r')}, {r('rt', 'round_trip_pct')}, {r('rt / 10', 'cost_r_10pct')},
      {r('be', 'breakeven_position')} FROM (SELECT *, {CM.side_pct('buy') + CM.side_pct('sell') + 0.3!r} + 15.93 / (entry_price * qty) * 100 AS rt,
        CASE WHEN rm * 10 > {CM.side_pct('buy') + CM.side_pct('sell') + 0.3!r} THEN 15.93 / (rm * 10 - {CM.side_pct('buy') + CM.side_pct('sell') + 0.3!r}) * 100 END AS be FROM tr)""",
      SM, SIG_SQL, sim_sql(), TRADED))
def trade_costs(spark, sf):
    x = taken(spark, sf).withColumn("value", F.col("entry_price") * F.col("qty"))
    x = x.select("sid", "cost", "cost_r", CM.round_trip_pct("value").alias("round_trip_pct"),
                 CM.cost_r(F.lit(10.0), "value").alias("cost_r_10pct"),
                 CM.breakeven_position(F.lit(10.0), "r_multiple").alias("breakeven_position"))
    return rounded(x, "cost", "cost_r", "round_trip_pct", "cost_r_10pct", "breakeven_position")


@query("2.6.14 2.4.16", sql(f"""SELECT symbol, {r('100 * quantile_cont(p, 0.5)', 'median_participation_pct')}, {r('100 * quantile_cont(p, 0.95)', 'p95_participation_pct')},
      {r('quantile_cont(b, 0.5)', 'median_bps')}, {r('quantile_cont(b, 0.95)', 'p95_bps')}, {r('2 * quantile_cont(b, 0.5) / 100', 'median_round_trip_pct')}
      FROM (SELECT *, least(500, greatest(0, 2 + 35 * sqrt(least(p, 1)))) AS b FROM (SELECT symbol, 5000 / turnover AS p FROM bars0 WHERE turnover > 0)) GROUP BY symbol""", supp()))
def slippage_bound(spark, sf):
    out = costs.retail_bound(t.bars(spark, sf, index=False), "turnover", 5000.0, ["symbol"])
    return rounded(out, *[c for c in out.columns if c != "symbol"])


@query("2.6.14", sql(f"""SELECT symbol, {day('session')}, {r('least(500, greatest(0, 2 + 35 * least(5000 / turnover, 1) + 0.05 * 3.5 * 100))', 'linear_bps')},
      {r('CASE WHEN 0.2 * 10 - 0.1222 > 0 THEN (0.2 * 10 - 0.1222) / (2 * 3.5) END', 'breakeven_mult')} FROM bars0""", supp()))
def slippage_linear(spark, sf):
    m = costs.SlippageModel(form="linear", atr_multiplier=0.05)
    b = t.bars(spark, sf, index=False).withColumns({"p": 5000 / F.col("turnover"), "a": F.lit(3.5)})
    b = b.withColumns({"linear_bps": m.bps("p", "a"), "breakeven_mult": m.breakeven_atr_multiplier(F.lit(0.2), F.lit(10.0), "a")})
    return show(b, "linear_bps", "breakeven_mult")


# ---- resampled sequences -------------------------------------------------

BOOT = lambda block, iid: [
    "sq AS (SELECT row_number() OVER (ORDER BY exit_date, symbol, sid) - 1 AS pos, rm AS r FROM tr)",
    f"""dr AS (SELECT path, blk, CAST(floor(CAST(('0x' || substr(md5('7|' || path || '|' || blk), 1, 8)) AS BIGINT) / 4294967296.0
          * ((SELECT count(*) FROM sq) - {1 if iid else block} + 1)) AS BIGINT) AS s FROM range(300) p(path), range({-(-100 // (1 if iid else block))}) b(blk))""",
    f"steps AS (SELECT path, blk * {1 if iid else block} + j AS t, s + j AS pos FROM dr, range({1 if iid else block}) g(j) WHERE blk * {1 if iid else block} + j < 100)",
    """eq AS (SELECT path, t, exp(sum(ln(greatest(1 + 0.01 * r, 0.01))) OVER (PARTITION BY path ORDER BY t)) AS e FROM steps JOIN sq USING (pos))""",
    """pk AS (SELECT path, t, e, greatest(1.0, max(e) OVER (PARTITION BY path ORDER BY t)) AS pk FROM eq)""",
    "paths AS (SELECT path, arg_max(e, t) AS f, max(1 - e / pk) AS d FROM pk GROUP BY path)"]
RUIN = f"""SELECT count(*) AS n_paths, {r('100 * (quantile_cont(f, 0.5) - 1)', 'median_return_pct')}, {r('100 * (quantile_cont(f, 0.05) - 1)', 'p5_return_pct')},
    {r('100 * (quantile_cont(f, 0.95) - 1)', 'p95_return_pct')}, {r('100 * quantile_cont(d, 0.5)', 'median_max_drawdown_pct')},
    {r('100 * quantile_cont(d, 0.95)', 'p95_max_drawdown_pct')}, {r('avg(CASE WHEN f < 1 THEN 1.0 ELSE 0 END)', 'prob_loss')},
    {r('avg(CASE WHEN d > 0.2 THEN 1.0 ELSE 0 END)', 'prob_drawdown_over_20')}, {r('avg(CASE WHEN d > 0.35 THEN 1.0 ELSE 0 END)', 'prob_drawdown_over_35')} FROM paths"""


def ruin(spark, sf, iid):
    trades = taken(spark, sf).select("exit_date", "symbol", "sid", F.col("r_multiple").alias("r"))
    seq = resample.numbered(trades, "exit_date", "symbol", "sid").select("pos", "r")
    rep = resample.ruin_report(resample.bootstrap_paths(seq, 100, 300, 20, iid=iid))
    return rounded(rep, *[c for c in rep.columns if c != "n_paths"])


@query("2.6.11", sql(RUIN, SM, SIG_SQL, sim_sql(), TRADED, BOOT(20, False)))
def bootstrap_ruin(spark, sf):
    return ruin(spark, sf, False)


@query("2.6.11", sql(RUIN, SM, SIG_SQL, sim_sql(), TRADED, BOOT(20, True)))
def bootstrap_ruin_iid(spark, sf):
    return ruin(spark, sf, True)


@query("2.6.12", sql(f"""SELECT exit_reason, {r('CASE WHEN avg(rm) > 0 AND stddev_samp(rm) > 0 THEN (2 * stddev_samp(rm) / avg(rm)) ** 2 END', 'trades_needed')}
      FROM tr GROUP BY exit_reason""", SM, SIG_SQL, sim_sql(), TRADED))
def trades_to_significance(spark, sf):
    g = taken(spark, sf).groupBy("exit_reason").agg(F.avg("r_multiple").alias("m"), F.stddev_samp("r_multiple").alias("s"))
    return g.select("exit_reason", r6(resample.trades_to_significance("m", "s"), "trades_needed"))
