"""Smoothing equals the recursive definition, gaps and long histories included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import ewm as ew
from barloom.functions import frames as W
from barloom.functions import order_stats
from barloom.functions.order_stats import Quantile, Rank, with_order_stats


def dense(panel, field="close"):
    p = panel.toPandas().pivot(index="idx", columns="symbol", values=field)
    return p.reindex(range(160))


def spread(df, col):
    return df.toPandas().pivot(index="idx", columns="symbol", values=col)


@pytest.mark.parametrize("span", [600.0, 4.0, 1.0])
def test_ewm_matches_pandas_across_blocks(panel, monkeypatch, span):
    monkeypatch.setattr(ew, "_SPAN", span)
    if span < 600:  # a block must still outlast double precision for the check to be exact
        monkeypatch.setattr(ew, "_SPAN", 40.0 if span == 4.0 else 38.0)
    got = spread(ew.ewm(panel, {"y": ("close", 0.5)}), "y")
    want = dense(panel).ewm(alpha=0.5, adjust=False).mean()
    np.testing.assert_allclose(got.to_numpy(), want.where(dense(panel).notna()).reindex(got.index).to_numpy(), rtol=1e-9)


def test_ewm_wilder_with_gaps(panel):
    got = spread(ew.ewm(panel, {"y": ("close", 1 / 14)}), "y")
    want = dense(panel).ewm(alpha=1 / 14, adjust=False).mean().where(dense(panel).notna())
    np.testing.assert_allclose(got.to_numpy(), want.reindex(got.index).to_numpy(), rtol=1e-10)


def test_hold_repeats_the_carried_value(panel):
    carried = dense(panel).ffill()
    got = spread(ew.ewm(panel, {"y": ("close", 0.2)}, hold=True), "y")
    want = carried.ewm(alpha=0.2, adjust=False).mean().where(dense(panel).notna())
    np.testing.assert_allclose(got.to_numpy(), want.reindex(got.index).to_numpy(), rtol=1e-10)


def test_frames_count_empty_sessions(panel):
    got = spread(panel.withColumn("y", W.sma("close", 20)), "y")
    want = dense(panel).rolling(20).mean().where(dense(panel).notna())
    np.testing.assert_allclose(got.to_numpy(), want.reindex(got.index).to_numpy(), rtol=1e-10)


def test_rolling_rank_and_quantile(panel):
    d = dense(panel)
    got = spread(with_order_stats(panel, {"y": Rank("close", 55, 20)}), "y")
    want = d.rolling(55, min_periods=20).rank(pct=True)
    np.testing.assert_allclose(got.to_numpy(), want.where(d.notna()).reindex(got.index).to_numpy(), rtol=1e-10)
    got = spread(with_order_stats(panel, {"y": Quantile("close", 0.2, 60, 40)}), "y")
    want = d.rolling(60, min_periods=40).quantile(0.2)
    np.testing.assert_allclose(got.to_numpy(), want.where(d.notna()).reindex(got.index).to_numpy(), rtol=1e-10)


def test_order_stats_with_ties_and_absent_values(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "AT_ONCE", 7)
    rng = np.random.default_rng(3)
    v = pd.Series(rng.integers(0, 6, 90).astype(float))
    v[rng.random(90) < .2] = np.nan
    rows = [("A", i, None if x != x else x) for i, x in enumerate(v) if i % 11]  # some sessions have no row, some a null
    v[np.arange(90) % 11 == 0] = np.nan
    df = spark.createDataFrame(rows, "symbol string, idx int, v double")
    stats = {"avg": Rank("v", 9, 3), "top": Rank("v", 9, 3, "max"), "wide": Rank("v", 200, 1), "q": Quantile("v", 0.35, 9, 2), "whole": Quantile("v", 0.5, 30)}
    got = with_order_stats(df, stats).toPandas().sort_values("idx").set_index("idx")
    w = v.rolling(9, min_periods=3)
    want = {"avg": w.rank(pct=True), "top": w.rank(method="max", pct=True), "wide": v.rolling(200, min_periods=1).rank(pct=True),
            "q": v.rolling(9, min_periods=2).quantile(0.35), "whole": v.rolling(30).quantile(0.5)}
    for name, s in want.items():
        np.testing.assert_allclose(got[name].to_numpy(float), s.reindex(got.index).to_numpy(), rtol=1e-12, err_msg=name)
    assert with_order_stats(df.where("false"), stats).count() == 0


def test_a_pass_is_one_sort_and_four_windows(panel):
    plan = ew.ewm(panel, {"y": ("close", 0.1), "z": ("volume", 0.3)})._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 4
    done = ew.ewm(panel, {"y": ("close", 0.1)})._jdf.queryExecution().executedPlan().toString()
    assert done.count("Sort [") == 1


def test_nothing_looks_ahead(panel):
    """Every window column at t is the same with and without the rows after t."""
    from barloom.operators import indicators as ind

    def build(df):
        df = ind.adx(ind.rsi(ind.macd(ind.atr(df))))
        return df.withColumns({**ind.bollinger(), **ind.aroon(), **ind.donchian(20), "cci": ind.cci(), "k": ind.stochastic_k(),
                               "wr": ind.williams_r(), **ind.ichimoku(9, 26, 52)})

    cut = 120
    cols = ["atr", "macd_hist", "rsi", "adx", "bb_lower", "aroon_up", "donchian_high", "cci", "k", "wr", "senkou_b"]
    a = build(panel).where(F.col("idx") == cut).select("symbol", *cols).toPandas().sort_values("symbol").set_index("symbol")
    b = build(panel.where(F.col("idx") <= cut)).where(F.col("idx") == cut).select("symbol", *cols).toPandas().sort_values("symbol").set_index("symbol")
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


@pytest.mark.parametrize("span,hole", [(9, (1501, 2699)), (2, (100, 698)), (200, (300, 2300))])
def test_long_gap_across_blocks(spark, span, hole):
    n = 6000
    x = 100 + np.cumsum(np.random.default_rng(1).normal(0, 1, n))
    x[hole[0]:hole[1]] = np.nan
    s = pd.Series(x)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "idx": np.flatnonzero(s.notna()).astype("int32"), "close": s.dropna()}))
    a = 2 / (span + 1)
    got = ew.ewm(df, {"y": ("close", a), "fast": ("close", 0.9)}).orderBy("idx").toPandas()
    for name, alpha in (("y", a), ("fast", 0.9)):
        want = s.ewm(alpha=alpha, adjust=False, ignore_na=False).mean()[s.notna()]
        np.testing.assert_allclose(got[name].to_numpy(), want.to_numpy(), rtol=1e-9)
