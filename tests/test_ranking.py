"""Distributed percentile ranks, feature parity and score arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.ranks import group_rank_pct
from barloom.functions.selection import group_quantiles
from barloom.operators import features as ft, ranking


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_rank_pct_equals_pandas_with_a_hot_tie(spark, buckets):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000, p=[.8, .15, .05]), "i": range(3000), "v": rng.normal(size=3000).round(2)})
    pdf.loc[rng.random(3000) < 0.35, "v"] = 0.5      # a third of all rows share one value
    pdf.loc[rng.random(3000) < 0.05, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = group_rank_pct(df, ["g"], "v", "p", buckets).toPandas().sort_values("i")
    want = pdf.groupby("g")["v"].rank(pct=True)
    np.testing.assert_allclose(got["p"].to_numpy(float), want.to_numpy(), rtol=1e-12)


def test_single_date_features_equal_the_series_form(panel):
    bench = panel.groupBy("session").agg(F.avg("close").alias("bench"))
    T = panel.agg(F.max("session")).first()[0]
    one = ft.stage1(panel, benchmark=bench).toPandas().set_index("symbol")
    ser = ft.stage1_series(panel, benchmark=bench).where(F.col("session") == F.lit(T)).toPandas().set_index("symbol")
    both = sorted(set(one.index) & set(ser.index))
    assert len(both) >= 5
    for c in ft.FEATURES:
        np.testing.assert_allclose(one.loc[both, c].astype(float), ser.loc[both, c].astype(float), rtol=1e-9, err_msg=c)
    # a name without a bar that day is still listed, with no price and no flag
    gone = one.loc[~one.index.isin(ser.index)]
    assert gone["close"].isna().all() and (gone["flag_count"] == 0).all()


def test_features_ignore_the_future(panel):
    T = panel.where("idx = 120").agg(F.max("session")).first()[0]
    a = ft.stage1(panel, T).toPandas().set_index("symbol").sort_index()
    b = ft.stage1(panel.where("idx <= 120"), T).toPandas().set_index("symbol").sort_index()
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_actions_and_short_histories_are_excluded(spark, panel):
    acts = spark.sql("select 'N0' symbol, date'2020-03-02' ex_date, 2.0D factor union all select 'N3', date'2020-03-02', 1.0D union all select 'N4', date'2030-01-01', 2.0D")
    got = {r.symbol for r in ft.stage1(panel, actions=acts, min_bars=125).select("symbol").collect()}
    assert "N0" not in got and "N1" not in got and {"N3", "N4"} <= got


def test_score_renormalises_and_needs_factors(spark):
    rows = [("d", "a", 1.0, 1.0, 1.0, 1.0, 1.0, False, 1), ("d", "b", 2.0, None, 2.0, 2.0, 2.0, True, 1), ("d", "c", 3.0, None, None, None, 3.0, False, 1)]
    df = spark.createDataFrame(rows, "session string, symbol string, ret_20d_pct double, dist_sma50_pct double, pos_52w_pct double, rel_volume double, atr_pct_rank double, extended boolean, flag_count int")
    got = {r.symbol: r for r in ranking.stage2(df).collect()}
    assert set(got) == {"a", "b"}           # c has two usable factors
    b = (100 * 2 / 3 * 1 + 100 * 1.0 * .75 + 100 * 1.0 * .5 + 100 * 2 / 3 * .5) / (1 + .75 + .5 + .5) - 15
    assert got["b"].score == pytest.approx(b) and got["b"].penalty == 15.0
    with pytest.raises(ValueError):
        ranking.stage2(df, (ranking.Factor("x", "absent", 1, 1.0),))


def test_hostile_regime_silences(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "symbol string, ret_20d_pct double, rel_volume double")
    assert [f.name for f in ranking.active_factors(df, ranking.DEFAULT_FACTORS, "crisis")] == ["participation"]
    status = {r.factor: r.status for r in ranking.factor_status(df, ranking.DEFAULT_FACTORS, "range").collect()}
    assert status["momentum"] == "active" and status["trend"] == "column is absent"


def test_ranks_and_scores_are_the_doubles_of_their_formula(spark):
    rows = [("d", f"s{k:02d}", *[float((k * m) % 53) for m in (1, 7, 11, 19, 23)], False, 1) for k in range(53)]
    df = spark.createDataFrame(rows, "session string, symbol string, ret_20d_pct double, dist_sma50_pct double, pos_52w_pct double, rel_volume double, atr_pct_rank double, extended boolean, flag_count int")
    for r in ranking.stage2(df.repartition(7)).collect():
        k = int(r.symbol[1:])
        up = [100.0 * ((k * m) % 53 + 1) / 53 for m in (1, 7, 11, 19)] + [100.0 * (53 - (k * 23) % 53) / 53]
        total = 0.0
        for x, f in zip(up, ranking.DEFAULT_FACTORS):
            total += x * f.weight
        assert [r[f"rank_{f.name}"] for f in ranking.DEFAULT_FACTORS] == up and r.score == total / 3.75


@pytest.fixture
def restless_cuts(spark, monkeypatch):
    """Cut points that come out differently every time they are computed, as merged sketches may; no broadcast keeps the first ones."""
    @F.pandas_udf("array<double>")
    def some(v: pd.Series) -> list:
        return sorted(np.random.default_rng().choice(v.to_numpy(), 20).tolist())

    monkeypatch.setattr(F, "percentile_approx", lambda c, share, accuracy: some(F.col(c)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def values_in_groups(spark):
    pdf = pd.DataFrame({"g": ["a", "b"] * 1000, "i": range(2000), "v": np.random.default_rng(5).normal(size=2000).round(3)})
    return pdf, spark.createDataFrame(pdf)


def test_ranks_hold_when_cuts_come_out_differently(spark, restless_cuts):
    pdf, df = values_in_groups(spark)
    got = group_rank_pct(df, ["g"], "v", "p").toPandas().sort_values("i")
    np.testing.assert_allclose(got["p"].to_numpy(float), pdf.groupby("g")["v"].rank(pct=True).to_numpy(), rtol=1e-12)


def test_quantiles_hold_when_cuts_come_out_differently(spark, restless_cuts):
    pdf, df = values_in_groups(spark)
    shares = {f"q{k}": k / 100 for k in range(1, 100, 7)}
    got = group_quantiles(df, ["g"], "v", shares).toPandas().set_index("g").sort_index()
    for name, share in shares.items():
        np.testing.assert_allclose(got[name], pdf.groupby("g")["v"].quantile(share).to_numpy(), rtol=1e-12)
