"""Per-symbol series statistics: Hurst, persistence, unit roots, volatility states."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import truth
from ..functions.tails import adf_stat, chi2_sf, kpss_p, kpss_stat, normal_cdf, tau_p

MIN_OBS = 120
# Null distribution of the Hurst estimate of a random walk by
# series length: mean, sd, then its quantiles at the levels in NULL_LEVELS.
NULL_LEVELS = (0.001, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
HURST_NULL = {
    120: (0.3982, 0.1288, 0.0371, 0.1012, 0.1442, 0.1792, 0.2262, 0.3082, 0.4020, 0.4899, 0.5638, 0.6051, 0.6743),
    180: (0.4055, 0.1198, 0.0777, 0.1324, 0.1690, 0.2022, 0.2451, 0.3230, 0.4079, 0.4907, 0.5606, 0.5990, 0.6636),
    250: (0.4123, 0.1145, 0.0884, 0.1453, 0.1851, 0.2187, 0.2599, 0.3327, 0.4159, 0.4941, 0.5603, 0.5971, 0.6536),
    375: (0.4185, 0.1075, 0.1113, 0.1723, 0.2048, 0.2360, 0.2763, 0.3432, 0.4205, 0.4948, 0.5575, 0.5911, 0.6497),
    500: (0.4370, 0.0948, 0.1607, 0.2154, 0.2464, 0.2745, 0.3116, 0.3730, 0.4395, 0.5047, 0.5590, 0.5886, 0.6406),
    750: (0.4607, 0.0758, 0.2141, 0.2746, 0.3050, 0.3313, 0.3615, 0.4103, 0.4633, 0.5142, 0.5562, 0.5806, 0.6243),
    1000: (0.4716, 0.0645, 0.2684, 0.3174, 0.3405, 0.3614, 0.3867, 0.4286, 0.4736, 0.5167, 0.5532, 0.5741, 0.6119),
    1250: (0.4777, 0.0569, 0.2976, 0.3400, 0.3628, 0.3821, 0.4036, 0.4393, 0.4794, 0.5176, 0.5501, 0.5690, 0.6018),
    1750: (0.4847, 0.0472, 0.3321, 0.3710, 0.3895, 0.4039, 0.4231, 0.4532, 0.4857, 0.5172, 0.5447, 0.5609, 0.5880),
    2500: (0.4889, 0.0392, 0.3638, 0.3943, 0.4096, 0.4229, 0.4376, 0.4631, 0.4898, 0.5159, 0.5385, 0.5523, 0.5755),
}


def positions(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("idx")
    return df.where("close IS NOT NULL").withColumn("pos", F.row_number().over(w) - 1)


def hurst(panel: DataFrame, max_lag: int = 100, min_obs: int = MIN_OBS) -> DataFrame:
    """Slope of ln(std of lagged log differences) on ln(lag), per symbol.

    All lags of a row come from one window pass and every spread is an aggregate
    column, so rows are never multiplied by the number of lags.
    """
    w = Window.partitionBy("symbol").orderBy("idx")
    lags = range(2, max_lag + 1)
    d = panel.where("close IS NOT NULL").withColumn("lx", F.log(F.when(F.col("close") > 0, F.col("close"))))
    d = d.select("symbol", "lx", *[(F.col("lx") - F.lag("lx", k).over(w)).alias(f"d{k}") for k in lags])
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_obs"), F.count("lx").alias("positive"),
                                F.array(*[F.struct(F.lit(float(k)).alias("lag"), F.stddev_pop(f"d{k}").alias("tau")) for k in lags]).alias("t"))
    cap = F.greatest(F.lit(4), F.least(F.floor(F.col("n_obs") / 4), F.lit(100)))
    g = g.withColumn("t", F.filter("t", lambda s: (s["lag"] <= cap) & (s["tau"] > 0)))
    usable = (F.col("n_obs") >= min_obs) & (F.col("positive") == F.col("n_obs")) & (F.size("t") >= 4)
    pts = g.select("symbol", "n_obs", F.size("t").alias("usable_lags"), usable.alias("ok"), F.explode_outer("t").alias("p"))
    return pts.groupBy("symbol", "n_obs", "usable_lags", "ok").agg(
        F.regr_slope(F.log("p.tau"), F.log("p.lag")).alias("h")).withColumn("h", F.when(F.col("ok"), F.col("h"))).drop("ok")


def hurst_pvalue(est: DataFrame) -> DataFrame:
    """Lower-tail p-value: null rows blended in ln(n), then linear in the quantiles."""
    sizes = sorted(HURST_NULL)
    n = F.greatest(F.least(F.col("n_obs").cast("double"), F.lit(float(sizes[-1]))), F.lit(float(sizes[0])))
    row = lambda k: F.array(*[F.lit(v) for v in HURST_NULL[k]])
    blend = None
    for lo, hi in zip(sizes, sizes[1:]):
        t = (F.log(n) - math.log(lo)) / (math.log(hi) - math.log(lo))
        mix = F.zip_with(row(lo), row(hi), lambda a, b: a + t * (b - a))
        cond = (n >= lo) & (n <= hi)
        blend = F.when(cond, mix) if blend is None else blend.when(cond, mix)
    e = est.withColumn("__q", blend)
    h, q = F.col("h"), lambda i: F.get("__q", F.lit(i + 2))
    p = F.when(h <= q(0), NULL_LEVELS[0]).when(h >= q(len(NULL_LEVELS) - 1), NULL_LEVELS[-1])
    for i in range(len(NULL_LEVELS) - 1):
        lo, hi = NULL_LEVELS[i], NULL_LEVELS[i + 1]
        p = p.when(h <= q(i + 1), lo + (h - q(i)) / (q(i + 1) - q(i)) * (hi - lo))
    return (e.withColumns({"null_mean": F.get("__q", F.lit(0)), "null_sd": F.get("__q", F.lit(1)),
                           "pvalue": F.when(h.isNotNull(), p)}).drop("__q"))


def mean_reversion_screen(est: DataFrame, max_p: float = 0.05, keys=()) -> DataFrame:
    """How many names pass against how many chance alone would pass."""
    g = est.groupBy(*keys).agg(F.count("h").alias("estimable"), F.count_if(F.col("h").isNull()).alias("refused"),
                               F.count_if(F.col("pvalue") <= max_p).alias("passed"), F.count_if(F.col("h") < 0.45).alias("fixed_threshold"))
    n = F.col("estimable")
    z = (F.col("passed") - 0.05 * n) / F.sqrt(F.when(n > 0, n * 0.05 * 0.95))
    return g.withColumns({"expected": 0.05 * n, "z": z, "significant": truth(F.abs(z) > 2)})


def persistence(panel: DataFrame, nlags: int = 30, min_obs: int = MIN_OBS) -> DataFrame:
    """Autocorrelations of returns, their size and square, with Ljung-Box.

    One row per symbol: arrays over lag 1..nlags, Q statistics and p-values at 5,
    10 and 20 lags, half-life of the size autocorrelation and the size-to-sign ratio.
    """
    w = Window.partitionBy("symbol").orderBy("idx")
    r = panel.where("close IS NOT NULL").withColumn("r", F.col("close") / F.lag("close").over(w) - 1.0).where("r IS NOT NULL")
    whole = Window.partitionBy("symbol")
    kinds = {"ret": F.col("r"), "abs": F.abs("r"), "sq": F.col("r") * F.col("r")}
    r = r.withColumns({k: v - F.avg(v).over(whole) for k, v in kinds.items()})
    lags = range(1, nlags + 1)
    d = r.select("symbol", *kinds, *[(F.col(k) * F.lag(k, j).over(w)).alias(f"{k}{j}") for k in kinds for j in lags])
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_obs"), *[
        F.array(*[F.sum(f"{k}{j}") / F.nullif(F.sum(F.col(k) * F.col(k)), F.lit(0.0)) for j in lags]).alias(f"acf_{k}") for k in kinds])
    n = F.col("n_obs")
    g = g.where(n >= min_obs)

    def box(kind, h):
        terms = F.transform(F.slice(f"acf_{kind}", 1, h), lambda a, i: a * a / (n - i - 1))
        return n * (n + 2) * F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)

    g = g.withColumns({f"q_{k}_{h}": box(k, h) for k in ("ret", "abs") for h in (5, 10, 20)})
    g = g.withColumns({f"p_{k}_{h}": chi2_sf(F.col(f"q_{k}_{h}"), F.lit(float(h))) for k in ("ret", "abs") for h in (5, 10, 20)})
    first = F.get("acf_abs", F.lit(0))
    below = F.filter(F.transform("acf_abs", lambda a, i: F.when((i >= 1) & (a < first / 2), i + 1)), lambda x: x.isNotNull())
    mean5 = lambda k: F.aggregate(F.transform(F.slice(f"acf_{k}", 1, 5), lambda a: F.abs(a)), F.lit(0.0), lambda s, x: s + x) / 5
    ratio = mean5("abs") / F.nullif(mean5("ret"), F.lit(0.0))
    return g.withColumns({"conf_band": 1.96 / F.sqrt(n), "half_life": F.when(first > 0, F.get(below, F.lit(0)).cast("double")),
                          "ratio": ratio, "verdict": F.when(ratio >= 3.0, "size persists, sign does not")
                          .when(ratio >= 1.5, "size persists more than sign").otherwise("no separation")})


def unit_roots(panel: DataFrame, min_obs: int = MIN_OBS) -> DataFrame:
    """ADF and KPSS per symbol with their agreement; nulls are opposite."""
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("idx")["close"].dropna().to_numpy(float)
        if len(x) < min_obs or np.ptp(x) == 0:
            return pd.DataFrame([(key[0], len(x), None, None, None, None)], columns=cols)
        a, k = adf_stat(x), kpss_stat(x)
        return pd.DataFrame([(key[0], len(x), a, tau_p(a), k, kpss_p(k))], columns=cols)

    cols = ["symbol", "n_obs", "adf", "adf_p", "kpss", "kpss_p"]
    t = panel.select("symbol", "idx", "close").groupBy("symbol").applyInPandas(
        run, "symbol string, n_obs long, adf double, adf_p double, kpss double, kpss_p double")
    root, level = F.col("adf_p") < 0.05, F.col("kpss_p") < 0.05
    return t.withColumn("verdict", F.when(root & ~level, "STATIONARY").when(~root & level, "NON-STATIONARY")
                        .when(root & level, "CONFLICTING").otherwise("INCONCLUSIVE"))


def _two_states(r: np.ndarray, rounds: int = 200, tol: float = 1e-8):
    """EM of a two-state Gaussian chain; returns filtered and smoothed P(high).

    The two probabilities of a step add to one, so the passes carry one number.
    """
    n, dev = len(r), np.abs(r - r.mean())
    calm = dev <= np.median(dev)
    mu = np.array([r[calm].mean(), r[~calm].mean()])
    var = np.array([r[calm].var(), r[~calm].var()]) + 1e-8
    stay, start, last = [0.95, 0.95], 0.5, -np.inf
    for _ in range(rounds):
        dens = np.exp(-0.5 * (r[:, None] - mu) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        d0, d1 = dens[:, 0].tolist(), dens[:, 1].tolist()
        s0, s1 = stay
        filt, norm, ahead, prior = [0.0] * n, [0.0] * n, [0.0] * n, start
        for t in range(n):                      # P(state 1) forward
            hi, lo = prior * d1[t], (1.0 - prior) * d0[t]
            norm[t] = hi + lo
            p = filt[t] = hi / norm[t]
            prior = ahead[t] = p * s1 + (1.0 - p) * (1.0 - s0)
        smooth, kept1, left0 = filt[:], 0.0, 0.0
        for t in range(n - 2, -1, -1):          # and backward, counting moves
            p, q, nxt = filt[t], ahead[t], smooth[t + 1]
            up1, up0 = nxt / q if q > 0 else 0.0, (1.0 - nxt) / (1.0 - q) if q < 1 else 0.0
            j11, j01 = p * s1 * up1, (1.0 - p) * (1.0 - s0) * up1
            smooth[t] = j11 + p * (1.0 - s1) * up0
            kept1 += j11
            left0 += j01
        s = np.array(smooth)
        w1, w0 = float(s[:-1].sum()), float((1.0 - s[:-1]).sum())
        stay = [1.0 - left0 / max(w0, 1e-12), kept1 / max(w1, 1e-12)]
        start, wt = smooth[0], np.array([(1.0 - s).sum(), s.sum()]) + 1e-12
        probs = np.column_stack([1.0 - s, s])
        mu = probs.T @ r / wt
        var = np.maximum((probs * (r[:, None] - mu) ** 2).sum(0) / wt, 1e-10)
        ll = float(np.log(norm).sum())
        if ll - last < tol * abs(ll):
            break
        last = ll
    f = np.array(filt)
    return (f, s) if var[1] > var[0] else (1.0 - f, 1.0 - s)


def volatility_states(panel: DataFrame, min_obs: int = 250) -> DataFrame:
    """Probability of the high-volatility state per symbol and session.

    One independent fit per symbol, over at most one return per session.
    """
    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        r = g["close"].pct_change().to_numpy(float) * 100.0
        ok = np.isfinite(r)
        if ok.sum() < min_obs or np.nanstd(r) == 0:
            return g.iloc[:0][["symbol", "session"]].assign(ret_pct=0.0, filtered=0.0, smoothed=0.0)
        f, s = _two_states(r[ok])
        return g.loc[ok, ["symbol", "session"]].assign(ret_pct=r[ok], filtered=f, smoothed=s)

    return panel.select("symbol", "session", "idx", "close").where("close IS NOT NULL").groupBy("symbol").applyInPandas(
        fit, "symbol string, session date, ret_pct double, filtered double, smoothed double")


def state_summary(states: DataFrame, reliable_from: int = 750) -> DataFrame:
    """Mean and annual volatility of each state, spread between them, reliability."""
    hi = F.col("smoothed") > 0.5
    r = F.col("ret_pct")
    g = states.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg(F.when(hi, r)).alias("high_mean"), F.avg(F.when(~hi, r)).alias("low_mean"),
        (F.stddev_samp(F.when(hi, r)) * 252 ** 0.5).alias("high_vol"), (F.stddev_samp(F.when(~hi, r)) * 252 ** 0.5).alias("low_vol"),
        F.avg(hi.cast("double")).alias("high_share"))
    return g.withColumns({"spread_pct": F.col("low_mean") - F.col("high_mean"), "reliable": F.col("n_obs") >= reliable_from})


def sharpe_robustness(returns: DataFrame, keys, r: str, trials: int = 1, periods: int = 252, benchmark: float = 0.0) -> DataFrame:
    """Probabilistic and deflated Sharpe with the minimum track record length.

    Moments are one aggregate; the deflation raises the benchmark to the best
    Sharpe expected among ``trials`` skill-less ones.
    """
    g = returns.groupBy(*keys).agg(F.count(r).alias("n"), F.avg(r).alias("__m"), F.stddev_samp(r).alias("__s"),
                                   F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess_kurtosis"))
    g = g.withColumn("sharpe", F.col("__m") / F.when(F.col("__s") > 0, F.col("__s"))).drop("__m", "__s")
    sr, n = F.col("sharpe"), F.col("n").cast("double")
    shape = 1 - F.col("skew") * sr + (F.col("excess_kurtosis") + 2) / 4 * sr * sr
    var = shape / F.when(n > 1, n - 1)
    bar = 0.0
    if trials > 1:
        z, e = NormalDist().inv_cdf, 0.5772156649015329
        bar = (1 - e) * z(1 - 1 / trials) + e * z(1 - 1 / (trials * math.e))
    zed = lambda floor: (sr - floor) / F.sqrt(F.when(var > 0, var))
    return g.withColumns({
        "annual_sharpe": sr * periods ** 0.5, "psr": normal_cdf(zed(F.lit(benchmark))),
        "dsr": normal_cdf(zed(benchmark + bar * F.sqrt(F.when(var > 0, var)))),
        "min_track_record": F.when(sr > benchmark, 1 + shape * F.pow(NormalDist().inv_cdf(0.95) / (sr - benchmark), F.lit(2.0)))})


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series eight further on."""
    z = x + 8.0
    head = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + _series(z)
    return head - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def _series(z: Column) -> Column:
    return 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0)))


def _beyond_stirling(x: Column) -> Column:
    """What log_gamma has beyond (x - 1/2) ln x - x + ln(2 pi) / 2."""
    return F.when(x > 100.0, _series(x)).otherwise(log_gamma(x) - ((x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)))


def _beta_terms(a: Column, b: Column, off: Column) -> Column:
    """ln of t^a (1 - t)^b / B(a, b) at ``off`` from the mean a / (a + b), without the large terms that cancel there."""
    mean = a / (a + b)
    return (0.5 * (F.log(a) + F.log(b) - F.log(a + b) - math.log(2 * math.pi)) + _beyond_stirling(a + b) - _beyond_stirling(a) - _beyond_stirling(b)
            + a * F.log1p(off / mean) + b * F.log1p(-off / (1 - mean)))


def _beta_fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """Continued fraction of the incomplete beta function, from its far end; for x below (a + 1) / (a + b + 2)."""
    def step(f, k):
        j = (F.lit(steps) - k).cast("double")  # steps .. 1
        even = j * (b - j) * x / ((a + 2 * j - 1) * (a + 2 * j))
        odd = -(a + j) * (a + b + j) * x / ((a + 2 * j) * (a + 2 * j + 1))
        return 1.0 + even / (1.0 + odd / f)

    far = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(1.0), step)
    return 1.0 / (1.0 - (a + b) * x / (a + 1) / far)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 300) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b >= 1, with the same work for every row."""
    front = F.exp(_beta_terms(a, b, x - a / (a + b)))
    low = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)
    part = front / p * _beta_fraction(p, q, y, steps)
    return F.when(low, part).otherwise(1.0 - part)


#: Where both parameters are beyond this the density is summed over NODES points instead: the fraction would need more steps.
SUM_FROM, NODES = 3000.0, 64


def _beta_sum(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b) of large a and b: the density summed from x outwards to where nothing is left of it."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    mean, spread = a / (a + b), F.sqrt(a * b / (a + b + 1)) / (a + b)
    above = x > mean
    end = F.when(above, F.least(F.lit(1.0), F.greatest(mean + 12 * spread, x + 6 * spread))).otherwise(
        F.greatest(F.lit(0.0), F.least(mean - 12 * spread, x - 6 * spread)))
    half = (end - x) / 2
    points = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(w)).alias("w")) for u, w in zip(nodes, weights)])

    def add(s, point):
        off = (x - mean) + half * (1 + point["u"])
        t = mean + off
        return s + point["w"] * F.exp(_beta_terms(a, b, off)) / (t * (1 - t))

    outside = F.abs(half) * F.aggregate(points, F.lit(0.0), add)
    return F.when(above, 1.0 - outside).otherwise(outside)


def binomial_tail(k, n, p: float) -> Column:
    """P(X >= k) of a binomial of n trials, as the incomplete beta function of k and n - k + 1.

    Counts are doubles and no step is made for a trial, so a row costs the same
    whatever its counts.
    """
    k, n = F.col(k).cast("double"), F.col(n).cast("double")
    a, b, x = F.greatest(k, F.lit(1.0)), F.greatest(n - k + 1, F.lit(1.0)), F.lit(float(p))
    tail = F.when((a > SUM_FROM) & (b > SUM_FROM), _beta_sum(a, b, x)).otherwise(incomplete_beta(a, b, x))
    return F.when(k.isNull() | n.isNull(), None).when(k > n, 0.0).when(k <= 0, 1.0).otherwise(tail)
