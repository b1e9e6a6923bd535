"""Feature table, ranking, setups and path-dependent outcome queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft, ranking
from . import tables as t
from .indicators import BENCH, BW, LAG, SM, TR, gate, layer, prior, rows, rs, show
from .oracle import brand, day, ewm as sql_ewm, panel as P, r, sql, supp
from .registry import query

DBL = [c for c in ft.FEATURES if c not in ("bars", "compressed", "unusual_volume", "unusual_move",
                                           "near_52w_high", "extended", "flag_count")]
FLAGS = ("compressed", "unusual_volume", "unusual_move", "near_52w_high", "extended")


def px(e: str) -> str:
    return f"CASE WHEN {e} > 0.01 THEN {e} END"


def rank_in(x: str, n: int, need: int) -> str:
    """Average-rank share of the last value of the list of the last n."""
    v = f"list_filter(list({x}) {rows(n)}, lambda v: v IS NOT NULL)"
    return (f"CASE WHEN {x} IS NOT NULL AND len({v}) >= {need} THEN 100.0 * (len(list_filter({v}, lambda v: v < {x})) "
            f"+ (len(list_filter({v}, lambda v: v = {x})) + 1) / 2.0) / len({v}) END")


def feature_sql(min_bars: int = 30, bench: bool = True) -> list[str]:
    lag = lambda c, k=1: f"lag({c}, {k}) {LAG}"
    return [
        layer("f0", f"{TR}, close - {lag('close')} AS d, high - {lag('high')} AS uph, {lag('low')} - low AS dnl"),
        layer("f1", """CASE WHEN d IS NOT NULL THEN greatest(d, 0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END AS dn,
            CASE WHEN uph IS NOT NULL AND dnl IS NOT NULL THEN CASE WHEN uph > dnl AND uph > 0 THEN uph ELSE 0.0 END END AS pdm,
            CASE WHEN uph IS NOT NULL AND dnl IS NOT NULL THEN CASE WHEN dnl > uph AND dnl > 0 THEN dnl ELSE 0.0 END END AS mdm""", "f0"),
        sql_ewm("f1", "s1", atr=("tr", "1.0/14"), sp=("pdm", "1.0/14"), sm=("mdm", "1.0/14"),
                g=("up", "1.0/14"), l=("dn", "1.0/14")),
        """f2 AS (SELECT f1.*, atr, 100 * sp / CASE WHEN atr > 0 THEN atr END AS plus_di_14,
             100 * sm / CASE WHEN atr > 0 THEN atr END AS minus_di_14, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi_14,
             100 * atr / CASE WHEN close > 0.01 THEN close END AS atr_pct FROM f1 JOIN s1 USING (symbol, idx))""",
        layer("f3", "CASE WHEN plus_di_14 + minus_di_14 > 0 THEN 100 * abs(plus_di_14 - minus_di_14) / (plus_di_14 + minus_di_14) END AS dx", "f2"),
        sql_ewm("f3", "s2", adx_14=("dx", "1.0/14")),
        "carry AS (SELECT session, last_value(bench IGNORE NULLS) OVER (ORDER BY session) AS bench FROM cal LEFT JOIN bench USING (session))",
        "f4 AS (SELECT f3.*, adx_14, close / CASE WHEN bench > 0.01 THEN bench END AS rs FROM f3 JOIN s2 USING (symbol, idx) LEFT JOIN carry USING (session))",
        layer("f5", f"""{gate('avg', 'close', 20)} AS bb_mid, {gate('stddev_samp', 'close', 20)} AS sd,
            CASE WHEN count(low) OVER c = 7 AND low = min(low) OVER c THEN idx END AS sw_idx,
            count(close) OVER (PARTITION BY symbol ORDER BY idx) AS bars""",
            "f4 WINDOW c AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"),
        layer("f6", f"100 * 4 * sd / {px('bb_mid')} AS bb_width_pct, bb_mid - 2 * sd AS bb_lower", "f5"),
        layer("f7", f"""
            {", ".join(f"100 * (close / {px(lag('close', k))} - 1) AS ret_{k}d_pct" for k in (1, 5, 20))},
            volume / nullif({gate('avg', 'volume', 20, prior(20))}, 0) AS rel_volume,
            100 * (open / {px(lag('close'))} - 1) AS gap_pct, {rank_in('atr_pct', 252, 60)} AS atr_pct_rank,
            {", ".join(f"100 * (close / {px(gate('avg', 'close', n))} - 1) AS dist_sma{n}_pct" for n in (20, 50, 200))},
            max(high) {rows(252)} AS high_52w, min(low) {rows(252)} AS low_52w, {gate('min', 'low', 20)} AS low_20,
            {gate('max', 'high', 20, prior(20))} AS prior_high_20, {gate('min', 'low', 10, prior(10))} AS prior_low_10,
            max(sw_idx) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS p_idx,
            CASE WHEN count(bb_width_pct) {rows(120)} >= 40 THEN quantile_cont(bb_width_pct, 0.2) {rows(120)} END AS squeeze,
            {rank_in('rs', 55, 20)} AS rs_rank""", "f6"),
        """f8 AS (SELECT f7.*, p.low AS swing_low, CAST(f7.idx - p_idx AS DOUBLE) AS swing_low_age,
            100 * (f7.close - low_52w) / nullif(high_52w - low_52w, 0) AS pos_52w_pct,
            coalesce(bb_width_pct <= squeeze, false) AS compressed FROM f7
            LEFT JOIN dense p ON p.symbol = f7.symbol AND p.idx = f7.p_idx)""",
        layer("f9", """coalesce(rel_volume >= 2, false) AS unusual_volume, coalesce(abs(ret_1d_pct) >= 1.5 * atr_pct, false) AS unusual_move,
            coalesce(pos_52w_pct >= 95, false) AS near_52w_high, coalesce(dist_sma20_pct >= 4 * atr_pct, false) AS extended""", "f8"),
        f"""feats AS (SELECT *, CAST(unusual_volume AS BIGINT) + CAST(unusual_move AS BIGINT) + CAST(near_52w_high AS BIGINT)
            + CAST(compressed AS BIGINT) AS flag_count FROM f9 WHERE bars >= {min_bars})""",
    ]


FEATURE_OUT = "symbol, bars, flag_count, " + rs(*DBL) + ", " + ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in FLAGS)
AS_OF = "2001-06-01"


def bench_of(b, need=25):
    return (b.groupBy("session").agg(F.avg("close").alias("bench"), F.count(F.lit(1)).alias("n"))
            .where(f"n >= {need}").drop("n"))


def features_at(b, as_of, **kw):
    f = ft.stage1(b, as_of, benchmark=bench_of(b), **kw)
    return f


def shown(f, keep=("symbol", "bars", "flag_count")):
    from .scans import rounded
    return rounded(f.withColumns({c: F.col(c).cast("int") for c in FLAGS}), *DBL).select(*keep, *DBL, *FLAGS)


@query("2.5.42 2.5.43 2.5.44 2.5.45 2.5.46 2.5.47 2.5.48 2.5.49 2.5.50 2.5.51 2.5.52 2.5.53 2.5.54 2.10.4",
       sql(f"SELECT {FEATURE_OUT} FROM feats WHERE session = DATE '{AS_OF}'", SM, BENCH, feature_sql()))
def stage1_features(spark, sf):
    return shown(features_at(t.bars(spark, sf), AS_OF))


@query("2.5.42 2.5.47", sql(f"SELECT {FEATURE_OUT} FROM feats WHERE session = (SELECT max(session) FROM cal)",
                            BW, BENCH, feature_sql()))
def stage1_features_weekly(spark, sf):
    return shown(features_at(t.brand_bars(spark, sf, "week"), None))


@query("2.5.42 2.6.8", sql(f"SELECT {FEATURE_OUT}, {day('session')} FROM feats WHERE close IS NOT NULL",
                            SM, BENCH, feature_sql()))
def stage1_features_series(spark, sf):
    from .scans import dated
    b = t.bars(spark, sf)
    return dated(shown(ft.stage1_series(b, benchmark=bench_of(b)),
                       ("symbol", "bars", "flag_count", "session")), "session")


def action_sql() -> str:
    """Price-changing actions: one per symbol whose average quantity is high."""
    return """acts AS (SELECT 'S' || l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex_date,
        CASE WHEN l_linenumber >= 6 THEN 2.0 ELSE 1.0 END AS factor FROM lineitem
        WHERE l_discount = 0.1 AND l_tax = 0.08 AND l_quantity >= 45)"""


def action_table(spark, sf):
    li = t.table(spark, sf, "lineitem").where("l_discount = 0.1 AND l_tax = 0.08 AND l_quantity >= 45")
    return li.select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("ex_date"),
                     F.when(F.col("l_linenumber") >= 6, 2.0).otherwise(1.0).alias("factor"))


@query("2.5.55 2.4.27", sql(f"""SELECT symbol, bars, CASE WHEN a.n > 0 THEN 'unadjusted corporate action in window'
        WHEN bars < 80 THEN 'fewer than 80 bars' END AS reason
      FROM (SELECT symbol, count(close) AS bars FROM bars0 GROUP BY symbol) b LEFT JOIN
        (SELECT symbol, count(*) AS n FROM acts WHERE factor <> 1 AND ex_date BETWEEN (SELECT min(session) FROM cal)
           AND DATE '{AS_OF}' GROUP BY symbol) a USING (symbol)""", supp(), "cal AS (SELECT DISTINCT session FROM bars0)", action_sql()))
def stage1_exclusions(spark, sf):
    return ft.exclusions(t.bars(spark, sf, index=False), action_table(spark, sf), AS_OF, 80)


def score_sql(factors, src: str, keys: str = "session", penalty: float = 15.0, need: int = 3) -> list[str]:
    rank = lambda f: (f"CASE WHEN {f.column} IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY {keys} ORDER BY {f.direction} * {f.column} NULLS LAST)"  # noqa: E731
                      f" + (count(*) OVER (PARTITION BY {keys}, {f.column}) - 1) / 2.0) / count({f.column}) OVER (PARTITION BY {keys}) END AS rank_{f.name}")
    ws = " + ".join(f"coalesce(rank_{f.name} * {f.weight}, 0)" for f in factors)
    wn = " + ".join(f"CASE WHEN rank_{f.name} IS NULL THEN 0 ELSE {f.weight} END" for f in factors)
    used = " + ".join(f"CAST(rank_{f.name} IS NOT NULL AS BIGINT)" for f in factors)
    return [f"rk AS (SELECT *, {', '.join(rank(f) for f in factors)} FROM {src})",
            f"""scored AS (SELECT *, {used} AS factors_used, CASE WHEN extended THEN {penalty} ELSE 0.0 END AS penalty,
              greatest(0, least(100, ({ws}) / nullif({wn}, 0) - CASE WHEN extended THEN {penalty} ELSE 0 END)) AS score
              FROM rk WHERE ({used}) >= {need})"""]


DEF_OUT = f"symbol, {day('session')}, factors_used, " + rs("score", "penalty", *[f"rank_{f.name}" for f in ranking.DEFAULT_FACTORS])


def dated_features(b, as_of):
    return features_at(b, as_of).withColumn("session", F.lit(as_of).cast("date"))


def ranked(spark, sf, factors=ranking.DEFAULT_FACTORS, **kw):
    return ranking.stage2(dated_features(t.bars(spark, sf), AS_OF), factors, **kw)


@query("2.5.56 2.5.57 2.5.58 2.5.59", sql(f"SELECT {DEF_OUT} FROM scored", SM, BENCH, feature_sql(),
       f"uni AS (SELECT * FROM feats WHERE session = DATE '{AS_OF}')", score_sql(ranking.DEFAULT_FACTORS, "uni")))
def stage2_scores(spark, sf):
    return show(ranked(spark, sf, flagged_only=False), "factors_used", "score", "penalty",
                *[f"rank_{f.name}" for f in ranking.DEFAULT_FACTORS])


@query("2.5.57 2.5.59 2.10.1", sql(f"SELECT symbol, factors_used, {r('score', 'score')} FROM scored ORDER BY score DESC, symbol LIMIT 10",
       SM, BENCH, feature_sql(), f"uni AS (SELECT * FROM feats WHERE session = DATE '{AS_OF}')",
       score_sql(ranking.REVERSAL_FACTORS, "uni")))
def stage2_reversal_top(spark, sf):
    s = ranked(spark, sf, ranking.REVERSAL_FACTORS, flagged_only=False)
    top = s.orderBy(F.desc("score"), "symbol").limit(10)
    return show(top.withColumn("session", F.lit(None).cast("date")), "factors_used", "score", keep=("symbol", "session")).drop("session")


@query("2.5.56 2.5.57 2.5.58", sql(f"SELECT symbol, {day('session')}, factors_used, {r('score', 'score')} FROM scored",
       SM, BENCH, feature_sql(), "uni AS (SELECT * FROM feats WHERE close IS NOT NULL AND flag_count > 0)",
       score_sql(ranking.REVERSAL_FACTORS, "uni")))
def stage2_scores_all_sessions(spark, sf):
    b = t.bars(spark, sf)
    s = ranking.stage2(ft.stage1_series(b, benchmark=bench_of(b)), ranking.REVERSAL_FACTORS)
    return show(s, "factors_used", "score")


@query("2.5.58", sql(f"""SELECT unnest(['momentum', 'trend', 'range_position', 'participation', 'calmness']) AS factor,
      unnest([1.0, 1.0, 0.75, 0.5, 0.5]) AS weight, unnest(['regime crisis is hostile to it', 'regime crisis is hostile to it',
        'regime crisis is hostile to it', CASE WHEN a = 0 THEN 'no values in this universe' ELSE 'active' END,
        CASE WHEN b = 0 THEN 'no values in this universe' ELSE 'active' END]) AS status
      FROM (SELECT count(rel_volume) AS a, count(atr_pct_rank) AS b FROM feats WHERE session = DATE '{AS_OF}')""",
      SM, BENCH, feature_sql()).replace("[1.0, 1.0, 0.75, 0.5, 0.5]", "CAST([1.0, 1.0, 0.75, 0.5, 0.5] AS DOUBLE[])"))
def stage2_factor_status(spark, sf):
    return ranking.factor_status(features_at(t.bars(spark, sf), AS_OF), ranking.DEFAULT_FACTORS, "crisis")


@query("2.5.60", sql(f"""SELECT symbol, {r('score', 'score')}, factor, {r('percentile', 'percentile')}, weight, better FROM (
      {" UNION ALL ".join(f"SELECT symbol, score, '{f.name}' AS factor, rank_{f.name} AS percentile, CAST({f.weight} AS DOUBLE) AS weight, '{'higher' if f.direction > 0 else 'lower'}' AS better FROM scored" for f in ranking.DEFAULT_FACTORS)})""",
      SM, BENCH, feature_sql(), f"uni AS (SELECT * FROM feats WHERE session = DATE '{AS_OF}')",
      score_sql(ranking.DEFAULT_FACTORS, "uni")))
def stage2_explained(spark, sf):
    e = ranking.explain(ranked(spark, sf, flagged_only=False), ranking.DEFAULT_FACTORS)
    from .scans import rounded
    return rounded(e, "score", "percentile")
