"""Exact selection, dominance counts and split orders against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.dominance import count_not_above
from barloom.functions.selection import group_quantiles, with_quantiles, with_stretch
from barloom.operators import metrics, pairs as pr, resample, series_stats as ss


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_quantiles_of_groups(spark, buckets):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, -3.0, float(rng.randrange(4))])) for _ in range(3000)]
    rows += [("one", 7.25), ("two", 1.0), ("two", 2.0), ("nulls", None), ("a", None)] + [("tie", 4.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "top": 1.0, "low": 0.0}
    got = {r.g: tuple(r)[1:] for r in group_quantiles(df, ["g"], "v", shares, buckets).collect()}
    for g in {r[0] for r in rows} - {"nulls"}:
        assert got[g] == pytest.approx(tuple(np.quantile([v for k, v in rows if k == g and v is not None], list(shares.values()))), abs=1e-12)
    assert "nulls" not in got
    whole = group_quantiles(df, [], "v", {"m": 0.5}, buckets).first()[0]
    assert whole == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert group_quantiles(df.where("false"), ["g"], "v", shares).count() == 0
    beside = with_quantiles(df.groupBy("g").agg(F.count(F.lit(1)).alias("n")), df, ["g"], "v", {"m": 0.5}).collect()
    assert {r.g: r.m for r in beside if r.g == "nulls"} == {"nulls": None} and len(beside) == 7


def test_no_percentile_over_a_whole_group(spark):
    plan = group_quantiles(spark.range(10).selectExpr("id % 2 g", "double(id) v"), ["g"], "v", {"m": .5})._jdf.queryExecution().toString()
    assert "percentile(" not in plan.replace("percentile_approx(", "")


def test_counts_of_earlier_values_not_above(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, rng.random(), 0.25, 1.0, -1.0])) for k in range(400)]
    got = {r.t: r.not_above for r in count_not_above(spark.createDataFrame(rows, "t int, v double"), "t", "v").collect()}
    assert got == {t: None if v is None else sum(w is not None and w <= v for _, w in rows[:t + 1]) for t, v in rows}
    assert count_not_above(spark.createDataFrame([], "t int, v double"), "t", "v").count() == 0


def trades(rng, hot):
    """Sessions of which one holds most trades, of many symbols and none."""
    return [("d1" if rng.random() < hot else f"d{rng.randrange(9)}", rng.choice([None, *"abcdefghij"]), k, rng.gauss(0, 1)) for k in range(500)]


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_drawdown_and_numbers_of_a_hot_session(spark, hot):
    rows = trades(random.Random(3), hot)
    df = spark.createDataFrame(rows, "exit_date string, symbol string, sid int, r_multiple double")
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    run = top = worst = 0.0
    for r in order:
        run += r[3]
        top = max(top, run)
        worst = min(worst, run - top)
    assert metrics.max_drawdown_r(df).first()[0] == pytest.approx(worst)
    got = {r.sid: r.pos for r in resample.numbered(df, "exit_date", "symbol", "sid").collect()}
    assert got == {r[2]: k for k, r in enumerate(order)}
    assert with_stretch(df, "symbol").select("__stretch").distinct().count() > 5  # the hot session is split


def test_false_discovery_over_ranges_equals_the_sorted_rule(spark):
    rng = random.Random(4)
    p = [rng.choice([None, rng.random(), rng.random() ** 6, 0.03]) for _ in range(700)]
    df = spark.createDataFrame([(f"y{i}", "x", v, 1.0, 10.0) for i, v in enumerate(p)], "y string, x string, pvalue double, beta double, half_life double")
    got = {r.y: r for r in pr.screen(df, 0.1).collect()}
    tested = sorted((v, f"y{i}") for i, v in enumerate(p) if v is not None)
    m, bound = len(tested), 1.0
    last = max((k for k, (v, _) in enumerate(tested, 1) if v <= k / m * 0.1), default=0)
    for k in range(m, 0, -1):
        v, y = tested[k - 1]
        bound = min(bound, v * m / k)
        assert got[y].qvalue == pytest.approx(bound) and got[y].passes == (k <= last)
    assert len(got) == 700 and 0 < last < m and all(got[f"y{i}"].qvalue is None for i, v in enumerate(p) if v is None)
    assert pr.screen(df.where("false"), 0.1).count() == 0


def tail(k, n, p):
    """By the logarithms of the terms, from the far end."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return math.fsum(map(math.exp, sorted(terms)))


@pytest.mark.parametrize("p", [0.02, 0.2, 0.5, 0.9])
def test_binomial_tail_by_the_incomplete_beta(spark, p):
    rng = random.Random(5)
    rows = [(rng.randint(1, n), n) for n in (1, 2, 5, 30, 400, 5000, 40_000) for _ in range(6)]
    rows += [(max(1, min(n, round(n * p + d * math.sqrt(n * p * (1 - p))))), n) for n in (30, 400, 5000, 40_000, 400_000) for d in (-4, -1, 0, 1, 2, 5)]
    got = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k long, n long, i int").select("i", ss.binomial_tail("k", "n", p).alias("t")).collect()
    for r in got:
        assert r.t == pytest.approx(tail(*rows[r.i], p), rel=1e-7, abs=1e-12), rows[r.i]
    big = spark.createDataFrame([(5 * 10 ** 11, 10 ** 12), (5, None), (None, 5), (0, 0), (1, 0)], "k long, n long").select(ss.binomial_tail("k", "n", 0.5).alias("t")).collect()
    assert big[0].t == pytest.approx(0.5, abs=1e-6) and [r.t for r in big[1:]] == [None, None, 1.0, 0.0]


def test_numbering_reads_stored_trades(spark, monkeypatch):
    """What comes before the numbers is worked out once: the cuts are taken from stored rows."""
    read, plain = [], resample.with_stretch
    monkeypatch.setattr(resample, "with_stretch", lambda d, *a: read.append(len(d.inputFiles())) or plain(d, *a))
    rows = spark.range(50).selectExpr("date_add(date'2024-01-01', cast(id % 3 as int)) exit_date", "concat('N', id % 7) symbol", "id sid")
    got = resample.numbered(rows, "exit_date", "symbol", "sid").orderBy("exit_date", "symbol", "sid").collect()
    assert [r.pos for r in got] == list(range(50)) and len(read) == 1 and read[0] > 0
