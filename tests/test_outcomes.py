"""Barrier outcomes, selection, allocation and resampling against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import metrics, outcomes as oc, resample, setups


def brute_lattice(pdf, n, stop, rr, hold):
    out = {}
    for s, g in pdf.groupby("symbol"):
        g = g.set_index("idx")
        for i in g.index:
            if i >= n - 1:
                continue
            e, last, hit = g.close[i], min(i + hold, n - 1), None
            for j in range(i + 1, last + 1):
                if j in g.index and g.low[j] <= e * (1 - stop / 100):
                    hit = (-1.0, j)
                elif j in g.index and g.high[j] >= e * (1 + rr * stop / 100):
                    hit = (rr, j)
                if hit:
                    break
            if not hit:
                if last not in g.index:
                    continue
                hit = ((g.close[last] - e) / (e * stop / 100), last)
            out[s, i] = hit
    return out


def test_lattice(panel):
    got = {(r.symbol, r.idx): (r.r, r.exit_at) for r in oc.lattice(panel, [dict(stop_pct=3.0, rr=2.0, hold=10)]).collect()}
    want = brute_lattice(panel.toPandas(), 160, 3.0, 2.0, 10)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_sequential_takes_no_overlap(panel):
    lat = oc.lattice(panel, [dict(stop_pct=3.0, rr=2.0, hold=10)]).select("symbol", "idx", "exit_at", "r")
    pdf = lat.toPandas().sort_values("idx")
    want = []
    for s, g in pdf.groupby("symbol"):
        busy = -1
        for row in g.itertuples():
            if row.idx > busy:
                want.append((s, row.idx))
                busy = row.exit_at
    assert sorted((r.symbol, r.idx) for r in oc.sequential(lat, "symbol").collect()) == sorted(want)
    sums = {r.symbol: (r.sum_r, r.trades) for r in oc.sequential_sums(lat, ["symbol"]).collect()}
    keep = pdf.merge(pd.DataFrame(want, columns=["symbol", "idx"])).groupby("symbol")["r"].agg(["sum", "count"])
    for s in sums:
        assert sums[s] == pytest.approx(tuple(keep.loc[s]))


BARS = [("A", d, *p) for d, p in zip(
    ["2020-01-01", "2020-01-02", "2020-01-03", "2020-01-06", "2020-01-07"],
    [(10, 11, 9.5, 10), (10, 10.5, 9.6, 10.2), (10.2, 12.5, 8.9, 11), (8, 9, 7, 8.5), (13, 14, 12, 13)])]


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame([(s, pd.Timestamp(d).date(), *map(float, p)) for s, d, *p in BARS],
                                 "symbol string, session date, open double, high double, low double, close double")


def signal(spark, sid, day, stop, target, qty=10):
    return spark.createDataFrame([(sid, "A", pd.Timestamp(day).date(), stop, target, qty)],
                                 "sid string, symbol string, decided_on date, stop double, target double, qty long")


@pytest.mark.parametrize("day,stop,target,horizon,want", [
    ("2020-01-01", 9.0, 12.0, 5, ("stop", 9.0, True, False)),      # one bar touches both: stop
    ("2020-01-01", 9.0, 20.0, 5, ("stop", 9.0, False, False)),
    ("2020-01-01", 8.5, 20.0, 5, ("stop", 8.0, False, True)),      # opens through the stop: filled at the open
    ("2020-01-01", 5.0, 12.9, 5, ("target", 13.0, False, True)),   # opens through the target
    ("2020-01-01", 5.0, 20.0, 2, ("time", 11.0, False, False)),
])
def test_simulated_exit(spark, bars, day, stop, target, horizon, want):
    r = oc.simulate(signal(spark, "x", day, stop, target), bars, horizon).first()
    assert r.refused is None
    assert (r.exit_reason, r.exit_price, r.ambiguous, r.gapped) == want


@pytest.mark.parametrize("day,stop,target,qty,floor,want", [
    ("2020-01-01", 9.0, 12.0, 0, None, "nothing to buy"),
    ("2020-01-07", 9.0, 12.0, 1, None, "no later session"),
    ("2020-01-01", 9.995, 12.0, 1, None, "opened at the stop"),
    ("2020-01-01", 9.0, 9.9, 1, None, "opened beyond the target"),
    ("2020-01-01", 9.8, 12.0, 1, 5.0, "risk too small for its slippage"),
])
def test_refusals(spark, bars, day, stop, target, qty, floor, want):
    r = oc.simulate(signal(spark, "x", day, stop, target, qty), bars, 5, min_risk_pct=floor).first()
    assert r.refused == want and r.exit_price is None


def test_drawdown_over_all_trades(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"exit_date": pd.to_datetime("2021-01-01") + pd.to_timedelta(rng.integers(0, 40, 400), "D"), "symbol": rng.choice(list("abc"), 400),
                        "sid": [f"{i:03d}" for i in range(400)], "r_multiple": rng.normal(0, 1, 400)})
    got = metrics.max_drawdown_r(spark.createDataFrame(pdf)).first()[0]
    run = pdf.sort_values(["exit_date", "symbol", "sid"])["r_multiple"].cumsum()
    assert got == pytest.approx(min(0, (run - run.cummax().clip(lower=0)).min()))


def test_allocation_uses_up_room(spark):
    day = pd.Timestamp("2021-01-04").date()
    rows = [(day, f"S{i:02d}", 100.0 - i, 100.0, 95.0, 110.0, 3.0, 1e7, "tech" if i < 4 else "bank", None, "illiquid_vs_adv" if i == 0 else None) for i in range(25)]
    c = spark.createDataFrame(rows, "session date, symbol string, score double, entry double, stop double, target double, atr_pct double, adv_shares double, sector string, cluster string, gate string")
    cfg = setups.RiskConfig(capital=1_000_000.0, risk_pct=0.5)
    got = setups.allocate(c, cfg, max_trades=4, top=20).orderBy("rank").collect()
    # 1000 shares by risk is 100,000: ten percent each; two fit in a sector of thirty, the third reaches it exactly
    assert [(r.symbol, r.approved, r.reason) for r in got] == [
        ("S00", False, "illiquid_vs_adv"), ("S01", True, None), ("S02", True, None), ("S03", True, None), ("S04", True, None)]
    tight = setups.RiskConfig(max_sector_pct=15.0, max_open_risk_pct=0.9)
    got = setups.allocate(c, tight, max_trades=4, top=6).orderBy("rank").collect()
    assert [r.reason for r in got] == ["illiquid_vs_adv", None, "sector_cap", "sector_cap", "portfolio_heat_cap", "portfolio_heat_cap"]


def test_permutation_keeps_signal_counts_and_repeats(spark):
    sig = spark.createDataFrame([("a", i) for i in (1, 5, 9)] + [("b", 2)], "symbol string, idx int")
    one = resample.permuted_signals(sig, F.lit(50), 6, 7).toPandas()
    assert (one.groupby(["symbol", "perm"]).size().unstack().loc["a"] == 3).all()
    two = resample.permuted_signals(sig.repartition(3), F.lit(50), 6, 7).toPandas()
    key = ["symbol", "perm", "idx"]
    pd.testing.assert_frame_equal(one.sort_values(key, ignore_index=True), two.sort_values(key, ignore_index=True))


def test_product_over_signs(spark):
    df = spark.createDataFrame([(1, 0.5), (1, -2.0), (1, -3.0), (2, 4.0), (2, 0.0), (3, -1.5)], "k int, x double")
    got = {r.k: r.p for r in df.groupBy("k").agg(metrics.product_over(F.col("x")).alias("p")).collect()}
    assert got == {1: pytest.approx(3.0), 2: 0.0, 3: pytest.approx(-1.5)}


def test_trade_metrics_and_worst_streak(spark):
    r = [1.0, -1.0, -2.0, 3.0, -1.0, -1.0, -1.0, 2.0]
    rows = [("a", pd.Timestamp("2021-01-01").date() + pd.Timedelta(days=i), x, 2, False) for i, x in enumerate(r)]
    rows.append(("a", pd.Timestamp("2021-03-01").date(), 50.0, 2, True))     # still open: not counted
    df = spark.createDataFrame(rows, "symbol string, entry_date date, trade_return_pct double, bars_held int, still_open boolean")
    m = metrics.trade_metrics(df).first()
    assert (m.closed_trades, m.max_losses_in_row) == (8, 3)
    assert m.win_rate_pct == pytest.approx(37.5) and m.profit_factor == pytest.approx(1.0)
    assert m.expectancy_pct == pytest.approx(np.mean(r)) and m.payoff_ratio == pytest.approx(2 / 1.2)
