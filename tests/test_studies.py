"""Statistics with a known answer or a brute-force twin."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import tails
from barloom.operators import clusters as cl, pairs as pr, series_stats as ss


def test_tails_at_published_points():
    assert tails.tau_p(-2.86, 1) == pytest.approx(0.05, abs=0.002)
    assert tails.tau_p(-3.43, 1) == pytest.approx(0.01, abs=0.002)
    assert tails.tau_p(-3.34, 2) == pytest.approx(0.05, abs=0.002)
    assert tails._chi2_sf(11.070, 5) == pytest.approx(0.05, abs=1e-4)
    assert tails._chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.kpss_p(0.463) == pytest.approx(0.05)


def series(spark, cols):
    rows = [(s, pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=i), i, float(x)) for s, v in cols.items() for i, x in enumerate(v) if x == x]
    return spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "symbol string, session date, idx int, close double")


def test_unit_roots_and_hurst_tell_walk_from_noise(spark):
    rng = np.random.default_rng(4)
    walk = 100 + np.cumsum(rng.normal(0, 1, 600))
    noise = 100 + rng.normal(0, 1, 600)
    df = series(spark, {"walk": walk, "noise": noise})
    v = {r.symbol: r for r in ss.unit_roots(df).collect()}
    assert v["noise"].verdict == "STATIONARY" and v["walk"].adf_p > 0.05
    h = {r.symbol: r for r in ss.hurst_pvalue(ss.hurst(df)).collect()}
    assert h["noise"].h < 0.1 and h["noise"].pvalue <= 0.001 and h["walk"].pvalue > 0.01


def test_volatility_states_find_the_planted_break(spark):
    rng = np.random.default_rng(5)
    r = np.concatenate([rng.normal(0, .5, 300), rng.normal(0, 3, 150), rng.normal(0, .5, 300)])
    st = ss.volatility_states(series(spark, {"x": 100 * np.cumprod(1 + r / 100)})).toPandas().sort_values("session")
    p = st["smoothed"].to_numpy()
    assert p[320:430].mean() > 0.9 and p[20:280].mean() < 0.1


def naive_clusters(V, names, cut):
    D = np.sqrt(np.clip((1 - V @ V.T / V.shape[1]) / 2, 0, 1))
    groups = [[i] for i in range(len(names))]
    while True:
        best = min(((np.mean([D[a, b] for a in g for b in h]), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y), default=None)
        if best is None or best[0] > cut:
            return {frozenset(names[i] for i in g) for g in groups}
        groups[best[1]] += groups.pop(best[2])


def test_clusters_equal_linkage_over_the_whole_universe(spark):
    rng = np.random.default_rng(6)
    f = rng.normal(size=(5, 240))
    raw = np.vstack([f[k % 5] * 1.2 + rng.normal(size=240) * (0.7 + 0.05 * k) for k in range(24)])
    V = (raw - raw.mean(1, keepdims=True)) / raw.std(1, keepdims=True)
    names = [f"n{k:02d}" for k in range(24)]
    df = spark.createDataFrame(list(zip(names, V.tolist())), "symbol string, v array<double>")
    got = cl.cluster_map(df, 0.5).toPandas()
    groups = {frozenset(g["symbol"]) for _, g in got.groupby("label")}
    assert groups == naive_clusters(V, names, math.sqrt(0.25))
    assert all(l.startswith("CORR:") for l in got["label"])


def walks(rng, names, days):
    """Prices of three groups of names that move together, and of names on their own."""
    common = rng.normal(size=(3, days))
    return {f"n{k:03d}": 100 * np.exp(np.cumsum(0.01 * (common[k % 4] * 1.5 + rng.normal(size=days) if k % 4 < 3 else rng.normal(size=days)))) for k in range(names)}


@pytest.mark.parametrize("threshold,delta", [(0.5, 0.0), (0.05, 0.0), (0.3, 0.3)])
def test_linkage_by_rounds_equals_plain_linkage(spark, threshold, delta):
    rng = np.random.default_rng(16)
    raw = rng.normal(size=(60, 80)) + rng.normal(size=(4, 80))[np.arange(60) % 4] * np.linspace(0.2, 1.6, 60)[:, None]
    V = (raw - raw.mean(1, keepdims=True)) / raw.std(1, keepdims=True)
    names = [f"n{k:02d}" for k in range(60)]
    df = spark.createDataFrame(list(zip(names, V.tolist())), "symbol string, v array<double>")
    cut = math.sqrt((1 - threshold) / 2)
    shrunk = (1 - delta) * (V @ V.T / V.shape[1])
    D = np.sqrt(np.clip((1 - shrunk) / 2, 0, 1))
    owner = cl._average_linkage(D, cut)
    want = {frozenset(names[i] for i in np.flatnonzero(owner == o)) for o in set(owner)}
    for one_task in (0, 2000):  # all components by rounds, all in one task
        got = cl.cluster_map(df, threshold, delta, one_task=one_task, block=13).toPandas()
        assert {frozenset(g["symbol"]) for _, g in got.groupby("label")} == want
    assert 1 < len(want) < 60


def test_names_that_cannot_be_measured_have_a_reason(spark):
    rng = np.random.default_rng(17)
    px = walks(rng, 12, 300)
    px["n001"][:250] = np.nan
    px["n002"][:] = 100.0
    got = {r.symbol: r for r in cl.clusters(series(spark, px)).collect()}
    assert len(got) == 12 and got["n001"].reason == "too few prices in the window" and got["n002"].reason == "the price did not move"
    assert all((r.label is None) == (r.reason is not None) for r in got.values()) and {r.n_obs for r in got.values()} == {249}
    assert got["n000"].label == got["n004"].label == "CORR:n000+2"
    cut = {r.symbol: (r.label, r.reason, r.n_obs) for r in cl.clusters(series(spark, px), as_of="2020-09-10").collect()}
    early = {n: v[:(dt.date(2020, 9, 10) - dt.date(2020, 1, 1)).days + 1] for n, v in px.items()}
    assert cut == {r.symbol: (r.label, r.reason, r.n_obs) for r in cl.clusters(series(spark, early)).collect()}
    short = cl.clusters(series(spark, {n: v[-150:] for n, v in px.items()})).collect()
    assert {r.reason for r in short} == {"too few sessions in which all names traded"} and len(short) == 12
    few = cl.clusters(series(spark, {n: px[n] for n in ("n000", "n003")})).collect()
    assert {r.reason for r in few} == {"too few names with enough prices"}


def test_gaps_on_the_same_days_are_no_correlation(spark):
    rng = np.random.default_rng(18)
    px = {f"x{k}": 100 * np.exp(np.cumsum(0.01 * rng.normal(size=300))) for k in range(6)}
    for n in ("x4", "x5"):
        px[n][50:90] = np.nan
    got = {r.symbol: r.label for r in cl.clusters(series(spark, px), completeness=0.8).collect()}
    assert got["x4"] != got["x5"]


def test_collisions_count_labels_alone(spark):
    top = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "c"), (2, "d"), (3, "c"), (3, "d")], "session int, symbol string")
    labels = spark.createDataFrame([("a", "L"), ("b", "L"), ("c", None), ("z", "L")], "symbol string, label string")
    got = {r.session: tuple(r)[1:] for r in cl.collisions(top, labels).collect()}
    assert got == {1: (3, 1, True), 2: (3, 2, False), 3: (2, 2, False)}


def test_fdr_matches_the_step_up_rule(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, None]
    df = spark.createDataFrame([(f"y{i}", "x", v, 1.0, 10.0) for i, v in enumerate(p)], "y string, x string, pvalue double, beta double, half_life double")
    got = {r.y: r for r in pr.screen(df, 0.10).collect()}
    assert [got[f"y{i}"].passes for i in range(9)] == [True] * 7 + [False, False]
    assert got["y4"].qvalue == pytest.approx(0.0672) and got["y8"].reason == "no p-value"


def test_cointegrated_pair_is_found(spark):
    rng = np.random.default_rng(8)
    x = 100 + np.cumsum(rng.normal(0, 1, 300))
    e = np.zeros(300)
    for i in range(1, 300):
        e[i] = 0.8 * e[i - 1] + rng.normal(0, .5)
    df = series(spark, {"X": x, "Y": 5 + 1.5 * x + e, "Z": 100 + np.cumsum(rng.normal(0, 1, 300))})
    pairs = spark.createDataFrame([("Y", "X"), ("Z", "X")], "y string, x string")
    s = {r.y: r for r in pr.pair_state(pr.aligned(df, pairs)).collect()}
    assert s["Y"].pvalue < 0.01 < s["Z"].pvalue and s["Y"].beta == pytest.approx(1.5, abs=0.05) and 1 < s["Y"].half_life < 10


def test_binomial_tail(spark):
    df = spark.createDataFrame([(3, 10), (0, 10), (11, 10)], "k long, n long").withColumn("t", ss.binomial_tail("k", "n", 0.3))
    want = sum(math.comb(10, i) * .3 ** i * .7 ** (10 - i) for i in range(3, 11))
    assert [r.t for r in df.collect()] == [pytest.approx(want), 1.0, 0.0]


def test_deflated_sharpe_formula(spark):
    r = np.random.default_rng(12).normal(0.05, 1.0, 400)
    df = spark.createDataFrame([("a", float(x)) for x in r], "k string, r double")
    one, many = (ss.sharpe_robustness(df, ["k"], "r", trials=n).first() for n in (1, 50))
    sr, c = r.mean() / r.std(ddof=1), r - r.mean()
    skew, kurt = (c ** 3).mean() / r.std() ** 3, (c ** 4).mean() / r.std() ** 4
    psr = tails.phi(sr * math.sqrt(399) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr ** 2))
    assert one.psr == pytest.approx(psr, rel=1e-9) and one.dsr == pytest.approx(psr, rel=1e-9)
    assert many.dsr < one.dsr and many.psr == pytest.approx(psr, rel=1e-9)
