"""Setups, gates, allocation, strategy replays, baselines, positions, journal."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import frames as W
from ..functions.scalars import r6
from ..functions.selection import with_quantiles
from ..operators import events as ev_ops, features as ft, journal, metrics, outcomes as oc, ranking, resample, setups
from ..session import cut_lineage
from . import tables as t
from .indicators import BENCH, BW, LAG, SM, gate, layer, prior, rs, show
from .oracle import brand, calm, day, panel as P, r, sql, supp
from .registry import query
from .scans import dated, rounded
from .signals import AS_OF, bench_of, feature_sql, features_at, score_sql
from .trades import SIG_SQL, sim_sql, volume_signals

CALM = P("", calm)
FEATS = [CALM, BENCH, feature_sql()]
SETUP_SQL = """setups AS (SELECT *, close AS entry, close + 2 * (close - stop) AS target, volume AS adv_shares FROM (
    SELECT *, CASE WHEN level IS NULL THEN close - 0.3 * am ELSE least(level - 0.05 * am, close - 0.1 * am) END AS stop,
      CASE WHEN level IS NOT NULL AND level - 0.05 * am > close - 0.1 * am THEN 'noise_floor'
           WHEN sw IS NOT NULL AND (l20 IS NULL OR sw >= l20) THEN 'swing_low' WHEN l20 IS NOT NULL THEN 'low_20' ELSE 'atr' END AS stop_basis
    FROM (SELECT *, greatest(sw, l20) AS level FROM (SELECT *, close * atr_pct / 100 AS am,
        CASE WHEN swing_low > 0 AND swing_low < close THEN swing_low END AS sw,
        CASE WHEN low_20 > 0 AND low_20 < close THEN low_20 END AS l20 FROM feats WHERE close > 0 AND atr_pct > 0))) WHERE stop > 0)"""


#: price noise of the derived bars is a multiple of a real panel's, so the ATR
#: multiples are scaled down to keep stops above zero
TIGHT = dict(stop_atrs=0.3, buffer_atrs=0.05, min_stop_atrs=0.1)


def feature_series(spark, sf):
    """Stored once: scores, setups and gates all read it."""
    b = cut_lineage(t.calm_bars(spark, sf))
    return cut_lineage(ft.stage1_series(b, benchmark=bench_of(b)))


@query("2.6.16", sql(f"SELECT symbol, {day('session')}, {rs('entry', 'stop', 'target', 'level')}, stop_basis FROM setups WHERE close IS NOT NULL",
                     FEATS, SETUP_SQL))
def trade_setups(spark, sf):
    return show(setups.propose(feature_series(spark, sf), **TIGHT), "entry", "stop", "target", "level", "stop_basis")


GATED_SQL = """gated AS (SELECT *, CASE WHEN trades = 0 THEN 'not_tradeable' WHEN atr_pct > 150 THEN 'extreme_volatility'
      WHEN adv_shares <= 0 THEN 'illiquid_vs_adv' WHEN atr_pct <= 0 THEN 'extreme_volatility'
      WHEN 100 * abs(entry - stop) / entry > 60 THEN 'stop_too_wide'
      WHEN abs(target - entry) / abs(entry - stop) < 1.5 THEN 'risk_reward_too_low'
      WHEN slip > 0.5 OR slip * entry / abs(entry - stop) > 25 THEN 'slippage_too_high' END AS gate
    FROM (SELECT *, (2 + 35 * sqrt(least(1, 900 / turnover))) / 100 AS slip FROM setups WHERE close IS NOT NULL))"""
LOOSE = setups.RiskConfig(max_instrument_atr_pct=150.0, max_stop_distance_pct=60.0)


def gated_setups(spark, sf, features=None):
    b = t.calm_bars(spark, sf)
    s = setups.propose(feature_series(spark, sf) if features is None else features, **TIGHT)
    s = s.join(b.select("symbol", "session", "turnover", "trades"), ["symbol", "session"])
    s = s.withColumns({"expected_slippage_pct": (2 + 35 * F.sqrt(F.least(F.lit(1.0), 900 / F.col("turnover")))) / 100,
                       "tradeable": F.col("trades") > 0, "data_age_days": F.lit(0)})
    return s.withColumn("gate", setups.gate_reason(LOOSE))


@query("2.6.17 2.2.19", sql(f"SELECT symbol, {day('session')}, {rs('entry', 'stop')}, coalesce(gate, 'passed') AS gate FROM gated", FEATS, SETUP_SQL, GATED_SQL))
def hard_gates(spark, sf):
    g = gated_setups(spark, sf).withColumn("gate", F.coalesce("gate", F.lit("passed")))
    return show(g, "entry", "stop", "gate")


@query("2.4.28", sql("SELECT reason, n FROM (SELECT gate AS reason, count(*) AS n FROM gated WHERE gate IS NOT NULL GROUP BY gate) ORDER BY n DESC, reason LIMIT 3",
                     FEATS, SETUP_SQL, GATED_SQL))
def no_trade_reasons(spark, sf):
    g = gated_setups(spark, sf).where("gate IS NOT NULL").withColumn("reasons", F.col("gate"))
    return setups.no_trade_reasons(g)


@query("2.6.31", sql(f"""SELECT symbol, {day('session')}, reasons, CASE WHEN reasons LIKE '%sector_cap%' OR reasons LIKE '%stale_data%' THEN 'watch' ELSE 'avoid' END AS list
     FROM (SELECT symbol, session, gate || CASE WHEN idx % 5 = 0 THEN ', sector_cap' WHEN idx % 7 = 0 THEN ', stale_data' ELSE '' END AS reasons FROM gated WHERE gate IS NOT NULL)""",
     FEATS, SETUP_SQL, GATED_SQL))
def rejected_shortlists(spark, sf):
    extra = F.when(F.col("idx") % 5 == 0, ", sector_cap").when(F.col("idx") % 7 == 0, ", stale_data").otherwise("")
    g = gated_setups(spark, sf).where("gate IS NOT NULL").withColumn("reasons", F.concat("gate", extra))
    return show(setups.shortlists(g), "reasons", "list")


def maker():
    """The maker digit of a brand stands for its sector."""
    return F.substring("symbol", 7, 1)


def candidates(spark, sf):
    """Gated setups of every session with their score and sector."""
    f = feature_series(spark, sf)
    g = gated_setups(spark, sf, f)
    score = ranking.stage2(f, ranking.REVERSAL_FACTORS, flagged_only=False)
    return (g.join(score.select("session", "symbol", "score"), ["session", "symbol"])
            .withColumns({"sector": maker(), "cluster": F.lit(None).cast("string")}))


@query("2.6.18 2.6.19")
def allocation_by_session(spark, sf):
    cfg = setups.RiskConfig(capital=10_000_000.0, max_adv_participation_pct=25.0)
    a = setups.allocate(candidates(spark, sf), cfg, max_trades=3, top=20)
    return dated(a, "session")


#: Tight enough that every cap is met, on an account of ten million.
BOOK = setups.RiskConfig(capital=10_000_000.0, risk_pct=3.0, max_position_pct=8.0, max_sector_pct=9.0, max_correlated_pct=10.0, max_open_risk_pct=12.5,
                         max_open_positions=9, max_adv_participation_pct=25.0, max_daily_loss_pct=4.0, max_drawdown_pct=20.0,
                         vol_reference_atr_pct=60.0, risk_off_exposure_pct=50.0, max_instrument_atr_pct=150.0, max_stop_distance_pct=60.0)
BOOK_TRADES, BOOK_TOP, BOOK_BARS = 3, 25, 4


def book_candidates(spark, sf):
    """Gated setups with what each would earn by its exit, cluster labels, events in the holding window and risk-off sessions."""
    f = feature_series(spark, sf)
    g = cut_lineage(gated_setups(spark, sf, f).drop("score"))
    sid = F.concat("symbol", F.lit("@"), "idx")
    sig = g.select(sid.alias("sid"), "symbol", F.col("session").alias("decided_on"), "stop", "target", F.lit(1).cast("long").alias("qty"))
    done = oc.simulate(sig, t.calm_bars(spark, sf), BOOK_BARS).where("refused IS NULL").select(
        "sid", F.col("exit_date").alias("exit_on"), (F.col("exit_price") - F.col("entry_price")).alias("exit_value"))
    score = ranking.stage2(f, ranking.REVERSAL_FACTORS, flagged_only=False).select("session", "symbol", "score")
    digit = F.substring("symbol", 7, 2).cast("int") % 10
    ev = t.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.expr("date_add(date'1997-06-01', int(p_partkey % 2500))").alias("event_date"),
                                                                F.lit("results").alias("purpose"), F.lit(True).alias("moving"))
    asks = g.select("symbol", F.col("session").alias("as_of")).distinct().withColumn("ask", F.lit(0))
    near = ev_ops.next_event(asks, ev).where(ev_ops.blocks(5)).select("symbol", F.col("as_of").alias("session"), F.lit(True).alias("near"))
    out = g.withColumn("sid", sid).join(done, "sid", "left").join(score, ["session", "symbol"]).join(near, ["symbol", "session"], "left")
    return out.withColumns({"sector": maker(), "cluster": F.when(digit <= 3, F.concat(F.lit("CORR:"), digit)), "event": F.coalesce("near", F.lit(False)),
                            "risk_off": F.month("session").isin(3, 9)})


_C = BOOK.capital
BOOK_SQL = [
    "sigs AS (SELECT symbol || '@' || idx AS sid, symbol, session AS decided_on, stop, target, CAST(1 AS BIGINT) AS qty FROM setups WHERE close IS NOT NULL)",
    *sim_sql(horizon=BOOK_BARS),
    "pev AS (SELECT p_brand AS symbol, DATE '1997-06-01' + CAST(p_partkey % 2500 AS INTEGER) AS d FROM part)",
    f"""cand AS (SELECT *, row_number() OVER (ORDER BY session, rank) AS rn FROM (SELECT g.session, g.symbol, g.entry, g.stop, g.atr_pct, g.adv_shares, g.gate,
          substr(g.symbol, 7, 1) AS sector, CASE WHEN CAST(substr(g.symbol, 7, 2) AS INTEGER) % 10 <= 3 THEN 'CORR:' || (CAST(substr(g.symbol, 7, 2) AS INTEGER) % 10) END AS cluster,
          EXISTS (SELECT 1 FROM pev WHERE pev.symbol = g.symbol AND d BETWEEN g.session AND g.session + 5) AS event, month(g.session) IN (3, 9) AS risk_off,
          CASE WHEN refused IS NULL THEN exit_date END AS exit_on, CASE WHEN refused IS NULL THEN exit_price - entry_price END AS exit_value,
          row_number() OVER (PARTITION BY g.session ORDER BY s.score DESC, g.symbol) AS rank
        FROM gated g JOIN scored s ON s.symbol = g.symbol AND s.session = g.session LEFT JOIN sim ON sim.sid = g.symbol || '@' || g.idx) WHERE rank <= {BOOK_TOP})""",
    # the book, row by row: what has come to its exit leaves at the first row of a session
    f"""book AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS DATE) AS session, CAST(0 AS BIGINT) AS stood, {_C!r}::DOUBLE AS equity, {_C!r}::DOUBLE AS peak, 0.0::DOUBLE AS today,
          CAST([] AS STRUCT(symbol VARCHAR, qty DOUBLE, entry DOUBLE, risk DOUBLE, sector VARCHAR, cluster VARCHAR, exit_on DATE, gain DOUBLE)[]) AS pos,
          CAST(NULL AS VARCHAR) AS reason, 0.0::DOUBLE AS qty, CAST(0 AS BIGINT) AS before, false AS seen
        UNION ALL
        SELECT rn, session, CASE WHEN seen AND why IS NULL THEN stood + 1 ELSE stood END, equity, peak, today,
          CASE WHEN seen AND why IS NULL THEN list_append(pos, {{'symbol': symbol, 'qty': q, 'entry': entry, 'risk': q * abs(entry - stop), 'sector': sector,
            'cluster': coalesce(cluster, sector), 'exit_on': exit_on, 'gain': coalesce(q * exit_value, 0)}}) ELSE pos END,
          why, CASE WHEN why IS NULL THEN q ELSE 0 END, len(pos), seen
        FROM (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN q1 <= 0 THEN 'qty_rounds_to_zero' WHEN q2 <= 0 THEN 'position_value_cap'
              WHEN coalesce(list_sum([p.qty * p.entry FOR p IN pos IF p.sector = nm]), 0) + q2 * entry > {_C * BOOK.max_sector_pct / 100.0!r} THEN 'sector_cap'
              WHEN cluster IS NOT NULL AND coalesce(list_sum([p.qty * p.entry FOR p IN pos IF p.cluster = cl]), 0) + q2 * entry > {_C * BOOK.max_correlated_pct / 100.0!r} THEN 'correlated_cap'
              WHEN coalesce(list_sum([p.risk FOR p IN pos]), 0) + q2 * abs(entry - stop) > {_C * BOOK.max_open_risk_pct / 100.0!r} THEN 'portfolio_heat_cap'
              WHEN q3 <= 0 THEN 'illiquid_vs_adv' END AS why, q3 AS q FROM (
          SELECT *, CASE WHEN adv_shares > 0 AND 100.0 * q2 / adv_shares > {BOOK.max_adv_participation_pct!r} THEN floor(adv_shares * {BOOK.max_adv_participation_pct!r} / 100.0) ELSE q2 END AS q3 FROM (
          SELECT *, CASE WHEN own + q1 * entry > {_C * BOOK.max_position_pct / 100.0!r} THEN greatest(0, floor(({_C * BOOK.max_position_pct / 100.0!r} - own) / entry)) ELSE q1 END AS q2 FROM (
          SELECT *, coalesce(list_sum([p.qty * p.entry FOR p IN pos IF p.symbol = sy]), 0) AS own,
            floor({_C!r} * (CASE WHEN risk_off THEN rp * {BOOK.risk_off_exposure_pct!r} / 100.0 ELSE rp END) / 100.0 / abs(entry - stop)) AS q1,
            CASE WHEN event THEN 'event_in_window' WHEN gate IS NOT NULL THEN gate
              WHEN len(pos) >= {BOOK.max_open_positions} AND len([p.symbol FOR p IN pos IF p.symbol = sy]) = 0 THEN 'max_open_positions'
              WHEN -today >= {_C * BOOK.max_daily_loss_pct / 100.0!r} THEN 'daily_loss_cap'
              WHEN greatest(0, (peak - equity) / peak * 100.0) >= {BOOK.max_drawdown_pct!r} THEN 'drawdown_cap' END AS early FROM (
          SELECT *, greatest(peak0, equity) AS peak, {BOOK.risk_pct!r} * least(1.0, {BOOK.vol_reference_atr_pct!r} / atr_pct) AS rp, stood < {BOOK_TRADES} AS seen FROM (
          SELECT c.rn, c.session, c.symbol, c.symbol AS sy, c.sector AS nm, c.cluster AS cl, c.entry, c.stop, c.atr_pct, c.adv_shares, c.gate, c.sector, c.cluster, c.event, c.risk_off,
            c.exit_on, c.exit_value, CASE WHEN b.session = c.session THEN b.stood ELSE 0 END AS stood, b.peak AS peak0,
            [p FOR p IN b.pos IF p.exit_on IS NULL OR p.exit_on > c.session] AS pos,
            b.equity + coalesce(list_sum([p.gain FOR p IN b.pos IF p.exit_on <= c.session]), 0) AS equity,
            CASE WHEN b.session = c.session THEN b.today ELSE coalesce(list_sum([p.gain FOR p IN b.pos IF p.exit_on = c.session]), 0) END AS today
          FROM book b JOIN cand c ON c.rn = b.rn + 1)))))))"""]


@query("2.6.18 2.6.19 2.6.17", sql(f"""SELECT {day('c.session', 'session')}, c.symbol, CAST(rank AS INTEGER) AS rank, reason IS NULL AS approved, reason, CAST(b.qty AS BIGINT) AS qty,
      {r('b.qty * c.entry', 'position_value')}, {r('b.qty * abs(c.entry - c.stop)', 'capital_at_risk')}, CAST(before AS INTEGER) AS open_positions, {r('today', 'realised_today')},
      {r('equity', 'equity')}, {r('greatest(0, (peak - equity) / peak * 100.0)', 'drawdown_pct')} FROM book b JOIN cand c USING (rn) WHERE seen""",
      FEATS, SETUP_SQL, GATED_SQL, "uni AS (SELECT * FROM feats WHERE close IS NOT NULL)", score_sql(ranking.REVERSAL_FACTORS, "uni"), BOOK_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def carried_book(spark, sf):
    """One book from the first session to the last, with every gate and cap that allocation has."""
    w = setups.walk_book(book_candidates(spark, sf), BOOK, BOOK_TRADES, BOOK_TOP)
    return dated(rounded(w, "position_value", "capital_at_risk", "realised_today", "equity", "drawdown_pct"), "session")


@query("2.6.20", sql(f"""SELECT {day('session')}, CAST(sum(n) AS BIGINT) AS positions, {r('sum(k)', 'open_risk')}, {r('sum(v)', 'exposure')}, {r('max(v)', 'largest_sector_exposure')}
     FROM (SELECT session, substr(symbol, 7, 1) AS sector, count(*) AS n, sum(10 * entry) AS v, sum(10 * abs(entry - stop)) AS k FROM gated
           WHERE gate IS NULL GROUP BY ALL) GROUP BY session""", FEATS, SETUP_SQL, GATED_SQL))
def portfolio_exposure(spark, sf):
    g = gated_setups(spark, sf).where("gate IS NULL").withColumns({"sector": maker(), "qty": F.lit(10)})
    return dated(rounded(setups.exposure(g), "open_risk", "exposure", "largest_sector_exposure"), "session")


PROP_SQL = """props AS (SELECT session, symbol, idx, 'donchian_breakout' AS strategy, close AS entry, close * (1 - 2 * atr_pct / 100) AS stop,
      close + 2 * (close - close * (1 - 2 * atr_pct / 100)) AS target, 100 * (close / prior_high_20 - 1) AS stretch
    FROM feats WHERE close > prior_high_20 AND prior_high_20 > 0 AND atr_pct > 0 AND close * (1 - 2 * atr_pct / 100) > 0
    UNION ALL SELECT session, symbol, idx, 'bollinger_rsi', close, bb_mid - 3 * sg, bb_mid, (bb_mid - close) / sg
    FROM (SELECT *, (bb_mid - bb_lower) / 2 AS sg FROM feats) WHERE close > 0 AND bb_mid > close AND atr_pct > 0 AND close <= bb_lower
      AND rsi_14 <= 45 AND sg > 0 AND bb_mid - 3 * sg > 0 AND close > bb_mid - 3 * sg AND close - (bb_mid - 3 * sg) >= 0.5 * close * atr_pct / 100)"""
PROP_OUT = f"symbol, {day('session')}, strategy, " + rs("entry", "stop", "target", "stretch")
setups_bollinger = lambda f: setups.bollinger_proposals(f, oversold=45.0)


@query("2.6.21 2.6.22 2.6.23 2.13.3", sql(f"SELECT {PROP_OUT} FROM props", BW, BENCH, feature_sql(), PROP_SQL))
def strategy_proposals(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    f = ft.stage1_series(b, benchmark=bench_of(b))
    return show(setups.donchian_proposals(f).unionByName(setups_bollinger(f)), "strategy", "entry", "stop", "target", "stretch")


@query("2.6.23 2.6.24 2.10.2", sql(f"""SELECT {PROP_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY strategy, session ORDER BY stretch DESC, symbol) AS n
      FROM props WHERE strategy = 'donchian_breakout') WHERE n <= 1""", BW, BENCH, feature_sql(), PROP_SQL))
def strategy_proposals_limited(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    f = ft.stage1_series(b, benchmark=bench_of(b))
    return show(setups.propose_all(f, "crisis", limit=1), "strategy", "entry", "stop", "target", "stretch")


REPLAY_SQL = ["""sigs AS (SELECT strategy || '/' || symbol || '@' || idx AS sid, strategy, symbol, session AS decided_on, stop, target, CAST(100 AS BIGINT) AS qty FROM props)""",
              sim_sql(horizon=8), "done AS (SELECT *, (exit_price - entry_price) / (entry_price - stop) AS rm FROM sim WHERE refused IS NULL)",
              "ws AS (SELECT session, least(3, idx // ((SELECT count(*) FROM cal) // 4)) AS w FROM cal)"]


def replayed(spark, sf):
    b = t.brand_bars(spark, sf, "week")
    f = ft.stage1_series(b, benchmark=bench_of(b))
    p = setups.donchian_proposals(f).unionByName(setups_bollinger(f)).join(b.select("symbol", "session", "idx"), ["symbol", "session"])
    sig = p.select(F.concat("strategy", F.lit("/"), "symbol", F.lit("@"), "idx").alias("sid"), "symbol", "strategy", "idx",
                   F.col("session").alias("decided_on"), "stop", "target", F.lit(100).cast("long").alias("qty"))
    sig = cut_lineage(sig)
    sim = oc.simulate(sig, b, 8).where("refused IS NULL")
    size = F.floor(b.agg(F.max("idx") + 1).scalar() / 4)
    return sim.join(sig.select("sid", "strategy", F.least(F.lit(3).cast("long"), F.floor(F.col("idx") / size)).alias("window")), "sid")


@query("2.6.8 2.4.13", sql(f"""SELECT strategy, w AS "window", count(*) AS trades, {r('avg(rm)', 'mean_r')}, {r('median(rm)', 'median_r')},
      CAST(count(*) >= 10 AS INTEGER) AS scored FROM done JOIN ws ON ws.session = decided_on GROUP BY ALL""", BW, BENCH, feature_sql(), PROP_SQL, REPLAY_SQL))
def strategy_walk_forward(spark, sf):
    done = cut_lineage(replayed(spark, sf))
    g = done.groupBy("strategy", "window").agg(F.count(F.lit(1)).alias("trades"), F.avg("r_multiple").alias("mean_r"))
    g = with_quantiles(g, done, ["strategy", "window"], "r_multiple", {"median_r": 0.5})
    return rounded(g.withColumn("scored", (F.col("trades") >= 10).cast("int")), "mean_r", "median_r")


PICK_SQL = ["uni AS (SELECT * FROM feats WHERE close IS NOT NULL)", score_sql(ranking.REVERSAL_FACTORS, "uni"),
            """pick AS (SELECT s.*, n FROM setups s JOIN (SELECT symbol, session, row_number() OVER (PARTITION BY session ORDER BY score DESC, symbol) AS n
                 FROM scored) USING (symbol, session) WHERE close IS NOT NULL)"""]


def scored_setups(spark, sf):
    f = feature_series(spark, sf)
    score = ranking.stage2(f, ranking.REVERSAL_FACTORS, flagged_only=False).select("session", "symbol", "score")
    return setups.propose(f, **TIGHT).join(score, ["session", "symbol"])


def as_signals(p, *more):
    return p.select(F.concat("symbol", F.lit("@"), "idx").alias("sid"), "symbol", F.col("session").alias("decided_on"),
                    "stop", "target", F.lit(100).cast("long").alias("qty"), *more)


@query("2.6.9 2.4.9 2.10.2", sql(f"""SELECT year(decided_on) AS year, count(*) AS proposed, count(*) FILTER (refused IS NULL) AS taken,
      {r('avg(CASE WHEN refused IS NULL THEN (exit_price - entry_price) / (entry_price - stop) END)', 'mean_r')} FROM sim GROUP BY year(decided_on)""",
      FEATS, SETUP_SQL, PICK_SQL,
      "sigs AS (SELECT symbol || '@' || idx AS sid, symbol, session AS decided_on, stop, target, CAST(100 AS BIGINT) AS qty FROM pick WHERE n <= 3)", sim_sql()))
def funnel_replay(spark, sf):
    top = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "symbol"))
    p = scored_setups(spark, sf).withColumn("n", top).where("n <= 3")
    sim = oc.simulate(as_signals(p), t.calm_bars(spark, sf), 5)
    return sim.groupBy(F.year("decided_on").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("proposed"), F.count_if(F.col("refused").isNull()).alias("taken"),
        r6(F.avg("r_multiple"), "mean_r"))


BASE_SQL = ["sigs AS (SELECT symbol || '@' || idx AS sid, symbol, session AS decided_on, stop, target, CAST(100 AS BIGINT) AS qty, n FROM pick)", sim_sql(),
            "outc AS (SELECT *, (exit_price - entry_price) / (entry_price - stop) AS rm FROM sim WHERE refused IS NULL)",
            """tri AS (SELECT trial, decided_on, rm, rk FROM (SELECT trial, s.decided_on, s.sid, row_number() OVER (PARTITION BY trial, s.decided_on
                 ORDER BY md5('0|' || trial || '|' || s.sid), s.sid) AS rk FROM sigs s, range(10) g(trial)) JOIN outc USING (sid, decided_on) WHERE rk <= 3)""",
            "tm AS (SELECT trial, avg(rm) AS e FROM tri GROUP BY trial)", "st0 AS (SELECT avg(rm) AS e FROM outc WHERE n <= 3)"]


@query("2.6.10 2.4.12", sql(f"""SELECT count(*) AS trials, {r('avg(e)', 'mean')}, {r('stddev_samp(e)', 'sd')}, {r('min(e)', 'lowest')}, {r('max(e)', 'highest')},
      {r('100.0 * avg(CASE WHEN e < (SELECT e FROM st0) THEN 1.0 ELSE 0 END)', 'percentile')} FROM tm""", FEATS, SETUP_SQL, PICK_SQL, BASE_SQL))
def random_baseline(spark, sf):
    """Every setup is simulated once; a trial only chooses among the outcomes."""
    top = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "symbol"))
    p = scored_setups(spark, sf).withColumn("n", top)
    sig = cut_lineage(as_signals(p, "n"))
    out = oc.simulate(sig, t.calm_bars(spark, sf), 5).where("refused IS NULL").select("sid", "r_multiple")
    trial = sig.select("sid", "decided_on", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("trial"))
    order = Window.partitionBy("trial", "decided_on").orderBy(resample.draw_key(0, "trial", "sid"), "sid")
    chosen = trial.withColumn("rk", F.row_number().over(order)).where("rk <= 3").join(out, "sid")
    trials = chosen.groupBy("trial").agg(F.avg("r_multiple").alias("expectancy_r"))
    strat = sig.where("n <= 3").join(out, "sid").agg(F.avg("r_multiple")).scalar()
    s = metrics.baseline_summary(trials, strat)
    return rounded(s, "mean", "sd", "lowest", "highest", "percentile")


# ---- position series -----------------------------------------------------

POS_SQL = [layer("p0", f"""CASE WHEN close > {gate('avg', 'close', 5, None)} THEN 1 WHEN close < 0.95 * {gate('avg', 'close', 5, None)} THEN -1 ELSE 0 END AS position""",
                 "(SELECT symbol, session, turnover / volume AS close, row_number() OVER (PARTITION BY symbol ORDER BY session) - 1 AS idx FROM bars0) z"),
           layer("p1", f"""coalesce(close / lag(close) {LAG} - 1, 0) AS dr, coalesce(lag(position) {LAG}, 0) AS held,
                 coalesce(abs(position - lag(position) {LAG}), abs(position)) AS tu""", "p0"),
           layer("p2", "held * dr - tu * 0.0005 AS sr", "p1"),
           layer("p3", "product(1 + sr) OVER (PARTITION BY symbol ORDER BY idx) AS equity", "p2")]


def positions(spark, sf):
    b = t.brand_bars(spark, sf, index=False).select("symbol", "session", (F.col("turnover") / F.col("volume")).alias("close"))
    b = b.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("session")) - 1)
    m = W.sma("close", 5)
    b = b.withColumn("position", F.when(F.col("close") > m, 1).when(F.col("close") < 0.95 * m, -1).otherwise(0))
    return metrics.backtest_positions(b)


@query("2.5.61 2.6.7", sql(f"""SELECT symbol, {day('min(session)', 'entry_date')}, {day('coalesce(arg_max(nd, idx) , max(session))', 'exit_date')}, any_value(position) AS direction,
       CAST(count(*) - CASE WHEN bool_or(nd IS NULL) THEN 1 ELSE 0 END AS BIGINT) AS bars_held, {r('100 * (product(1 + coalesce(nr, 0)) - 1)', 'trade_return_pct')},
       CAST(bool_or(nd IS NULL) AS INTEGER) AS still_open FROM (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY idx) AS run, lead(sr) OVER (PARTITION BY symbol ORDER BY idx) AS nr,
         lead(session) OVER (PARTITION BY symbol ORDER BY idx) AS nd FROM (SELECT *, CASE WHEN position = lag(position) OVER (PARTITION BY symbol ORDER BY idx) THEN 0 ELSE 1 END AS chg FROM p3))
       WHERE position <> 0 GROUP BY symbol, run""", brand(), POS_SQL))
def position_trades(spark, sf):
    tr = metrics.position_trades(positions(spark, sf))
    return dated(rounded(tr.withColumns({"still_open": F.col("still_open").cast("int"), "bars_held": F.col("bars_held").cast("long")}),
                         "trade_return_pct"), "entry_date", "exit_date")


@query("2.4.11", sql(f"""SELECT symbol, bars, {r('100 * (g - 1)', 'total_return_pct')}, {r('CASE WHEN g > 0 THEN 100 * (g ** (252.0 / bars) - 1) END', 'cagr_pct')},
       {r('m / s * sqrt(252)', 'sharpe')}, {r('CASE WHEN ds > 0 THEN m / ds * sqrt(252) END', 'sortino')}, {r('mdd', 'max_drawdown_pct')}, {r('100 * s * sqrt(252)', 'volatility_pct')}, {r('ex', 'exposure_pct')}
     FROM (SELECT symbol, count(*) AS bars, arg_max(equity, idx) / arg_min(equity, idx) AS g, avg(sr) AS m, stddev_samp(sr) AS s, stddev_samp(sr) FILTER (sr < 0) AS ds,
       100 * min(equity / pk - 1) AS mdd, 100.0 * avg(CASE WHEN position <> 0 THEN 1.0 ELSE 0 END) AS ex FROM
       (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY idx) AS pk FROM p3) GROUP BY symbol)""", brand(), POS_SQL))
def position_metrics(spark, sf):
    m = metrics.position_metrics(positions(spark, sf))
    return rounded(m, *[c for c in m.columns if c not in ("symbol", "bars")])


@query("2.4.11")
def position_trade_metrics(spark, sf):
    m = metrics.trade_metrics(metrics.position_trades(positions(spark, sf)))
    return rounded(m, *[c for c, ty in m.dtypes if ty == "double"])


@query("2.2.20", sql(f"""SELECT symbol, {day('session')}, stance, list_sort(list_distinct(list_filter([
       CASE WHEN list_sum(fr) > 1 + 1e-9 THEN 'fractions over one' END,
       CASE WHEN d > 0 AND low >= open THEN 'stop not below a long entry' END, CASE WHEN d < 0 AND low <= open THEN 'stop not above a short entry' END,
       CASE WHEN d > 0 AND high <= open THEN 'target not above a long entry' END, CASE WHEN d < 0 AND high >= open THEN 'target not below a short entry' END],
       lambda x: x IS NOT NULL))) AS errors FROM (SELECT *, [0.5, CASE WHEN trades % 3 = 0 THEN 0.6 ELSE 0.5 END] AS fr,
         CASE stance WHEN 'Buy' THEN 1 WHEN 'Sell' THEN -1 ELSE 0 END AS d FROM (SELECT *, CASE trades % 4 WHEN 0 THEN 'Buy' WHEN 1 THEN 'Sell' WHEN 2 THEN 'Hold' ELSE 'REVIEW' END AS stance FROM bars0))""", supp()))
def proposal_errors(spark, sf):
    b = t.bars(spark, sf, index=False)
    k = F.col("trades") % 4
    b = b.withColumns({"stance": F.when(k == 0, "Buy").when(k == 1, "Sell").when(k == 2, "Hold").otherwise("REVIEW"),
                       "entry": F.col("open"), "stop": F.col("low"), "target": F.col("high"),
                       "fractions": F.array(F.lit(0.5), F.when(F.col("trades") % 3 == 0, 0.6).otherwise(0.5))})
    return dated(b.select("symbol", "session", "stance", F.array_sort(setups.proposal_errors()).alias("errors")), "session")


# ---- journal -------------------------------------------------------------

@query("2.6.29", sql("""SELECT conv_id, max(turn) AS version, count(*) AS versions, arg_max(role, turn) AS role,
      arg_max(substr(sha256(CAST(to_json({'role': role, 'text': text, 'turn': turn}) AS VARCHAR)), 1, 16), turn) AS digest FROM conversations GROUP BY conv_id"""))
def decision_versions(spark, sf):
    c = t.table(spark, sf, "conversations").withColumn("digest", journal.digest("turn", "role", "text"))
    c = c.withColumnRenamed("turn", "version")
    return journal.latest_versions(c, "conv_id").select("conv_id", "version", "versions", "role", "digest")


@query("2.6.30 2.11.15", sql("""SELECT o_orderkey, substr(sha256(CAST(to_json({'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}) AS VARCHAR)), 1, 16) AS digest FROM orders"""))
def content_digest(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", journal.digest("o_orderkey", "o_custkey", "o_orderstatus").alias("digest"))


@query("2.6.40", sql("""SELECT conv_id, turn AS version, role, CAST(NULL AS VARCHAR) AS replaces FROM conversations UNION ALL
      SELECT conv_id, max(turn) + 1, 'amended', arg_max(substr(sha256(CAST(to_json({'role': role, 'turn': turn}) AS VARCHAR)), 1, 16), turn)
      FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id"""))
def amended_decisions(spark, sf):
    c = t.table(spark, sf, "conversations").withColumn("digest", journal.digest("turn", "role")).select(
        "conv_id", F.col("turn").alias("version"), "role", "digest")
    change = c.where("conv_id % 3 = 0").select("conv_id").distinct().withColumns(
        {"role": F.lit("amended"), "reason": F.lit("corrected")})
    return journal.amend(c, change, "conv_id").select("conv_id", "version", "role", "replaces")


OUT_SQL = "outs AS (SELECT sid, symbol, decided_on, CASE WHEN qty % 3 = 0 THEN 'open' ELSE 'closed' END AS status FROM sigs WHERE qty % 2 = 0)"


def journal_tables(spark, sf):
    b = t.bars(spark, sf)
    d = volume_signals(b)
    o = d.where("qty % 2 = 0").select("sid", "symbol", "decided_on", F.when(F.col("qty") % 3 == 0, "open").otherwise("closed").alias("status"))
    return b, d, o


@query("2.4.25", sql(f"SELECT {day('decided_on', 'decided_on')}, count(*) AS missing FROM sigs WHERE sid NOT IN (SELECT sid FROM outs) GROUP BY decided_on", SM, SIG_SQL, OUT_SQL))
def unrecorded_decisions(spark, sf):
    _, d, o = journal_tables(spark, sf)
    return dated(journal.unrecorded(d, o, ("decided_on", "symbol")), "decided_on")


@query("2.6.38", sql(f"SELECT sid, symbol, {day('decided_on', 'decided_on')}, status FROM outs WHERE status <> 'closed'", SM, SIG_SQL, OUT_SQL))
def open_positions(spark, sf):
    return dated(journal.open_positions(journal_tables(spark, sf)[2]), "decided_on")


@query("2.6.27 2.6.28", sql(f"""SELECT sid, symbol, refused, exit_reason, {r('pnl', 'pnl')}, {r('rm', 'r_multiple')} FROM (SELECT sid, symbol, refused,
       CASE WHEN refused IS NULL THEN exit_reason END AS exit_reason, CASE WHEN refused IS NULL AND qty <> 0 THEN (exit_price - entry_price) * qty END AS pnl,
       CASE WHEN refused IS NULL THEN (exit_price - entry_price) / abs(entry_price - stop) END AS rm
     FROM sim WHERE sid NOT IN (SELECT sid FROM outs WHERE status = 'closed'))""", SM, SIG_SQL, OUT_SQL, sim_sql()))
def journal_settlement(spark, sf):
    b, d, o = journal_tables(spark, sf)
    s = journal.settle(d, o, b, 5).withColumns(journal.outcome_values(entry="entry_price"))
    return rounded(s.select("sid", "symbol", "refused", "exit_reason", "pnl", "r_multiple"), "pnl", "r_multiple")


@query("2.6.39", sql(f"SELECT sid, symbol, {day('decided_on', 'decided_on')}, CASE WHEN status = 'open' AND sid LIKE 'S1%' THEN 'closed' ELSE status END AS status FROM outs", SM, SIG_SQL, OUT_SQL))
def manual_close(spark, sf):
    o = journal_tables(spark, sf)[2]
    closed = o.where("status = 'open' AND sid LIKE 'S1%'").withColumn("status", F.lit("closed"))
    return dated(journal.upsert(o, closed, ["sid"]), "decided_on")


@query("2.6.41", sql("""SELECT lag_days, count(*) AS decisions, count(*) FILTER (lag_days > 0) AS reconstructed FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE),
      CAST(o_orderdate + to_days(CAST(o_orderkey % 4 AS INTEGER)) + INTERVAL '20 hours' + INTERVAL '5 hours 30 minutes' AS DATE)) AS lag_days FROM orders) GROUP BY lag_days"""))
def reconstruction_lag(spark, sf):
    o = t.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("as_of"), F.expr(
        "cast(o_orderdate as timestamp) + make_dt_interval(cast(o_orderkey % 4 as int), 20)").alias("recorded_at"))
    o = o.withColumn("lag_days", journal.reconstruction_lag().cast("long"))
    return o.groupBy("lag_days").agg(F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("lag_days") > 0).alias("reconstructed"))


DAY = "2000-03-01"


@query("2.6.32 2.2.1", sql(f"""SELECT '{DAY}' AS as_of, (SELECT count(*) FROM bars WHERE session = DATE '{DAY}') AS universe_scanned, (SELECT count(*) FROM bars WHERE session = DATE '{DAY}' AND close >= 1500) AS survived_stage0,
      (SELECT count(*) FROM uni) AS survived_stage1, (SELECT count(*) FROM scored) AS survived_stage2, count(*) AS analysed, count(*) FILTER (gate IS NULL) AS approved,
      coalesce(string_agg(CASE WHEN gate IS NULL THEN symbol END, ',' ORDER BY n), '') AS trades,
      CASE WHEN count(*) FILTER (gate IS NULL) = 0 THEN 'NO TRADE - ' || (SELECT string_agg(gate, ', ' ORDER BY c DESC, gate) FROM (SELECT gate, count(*) AS c FROM short WHERE gate IS NOT NULL GROUP BY gate ORDER BY c DESC, gate LIMIT 3)) END AS no_trade_reason FROM short""",
      FEATS, SETUP_SQL, GATED_SQL, f"uni AS (SELECT * FROM feats WHERE session = DATE '{DAY}' AND close IS NOT NULL)", score_sql(ranking.REVERSAL_FACTORS, "uni"),
      f"short AS (SELECT symbol, gate, n FROM (SELECT g.symbol, gate, row_number() OVER (ORDER BY score DESC, g.symbol) AS n FROM gated g JOIN scored s USING (symbol, session)) WHERE n <= 12)"))
def daily_plan(spark, sf):
    from ..operators import plan
    f = feature_series(spark, sf)
    day_ = f.where(F.col("session") == F.lit(DAY).cast("date"))
    u = t.calm_bars(spark, sf).where(F.col("session") == F.lit(DAY).cast("date")).select("symbol", F.when(F.col("close") < 1500, "below price floor").alias("reason"))
    score = cut_lineage(ranking.stage2(day_, ranking.REVERSAL_FACTORS, flagged_only=False).select("session", "symbol", "score"))
    g = gated_setups(spark, sf, day_).join(score, ["session", "symbol"])
    short = g.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "symbol"))).where("rank <= 12")
    p = plan.daily_plan(u, day_, score, cut_lineage(short.select("symbol", "rank", F.col("gate").alias("reason"))), DAY)
    return dated(p, "as_of")
