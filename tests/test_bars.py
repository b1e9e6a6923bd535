"""Bars of every grain from raw lines: order inside a session, odd keys, and the plan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.plans import tables as t

LINE = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
        "l_shipdate date, l_returnflag string, l_linestatus string")


def lines(spark, rows, tmp_path):
    path = tmp_path / "sf"
    spark.createDataFrame(rows, LINE).repartition(3).write.parquet(str(path / "lineitem.parquet"))
    return str(path)


def rank(r):
    """Day, order, line, part, each with nulls last."""
    return [(v is None, v or 0) for v in (r[6], r[0], r[1], r[2])]


@pytest.mark.parametrize("grain", ["day", "week", "month", "quarter", "year"])
def test_open_and_close_follow_the_order_of_lines(spark, tmp_path, grain):
    rng = random.Random(3)
    odd = [None, -5, 0, 2 ** 62, -2 ** 63, 2 ** 63 - 1, 10 ** 18, 7]
    rows = [(rng.choice(odd), rng.choice([None, 1, 2, 200, -1, 2 ** 31 - 1]), rng.choice([None, 1, 2, 77]), rng.randint(1, 3), 1.0, float(k),
             dt.date(2001, 1, 1) + dt.timedelta(rng.randint(0, 420)), "A", "F") for k in range(1, 600)]
    if grain == "year":  # many lines of one key on one day: only the part key tells them apart
        rows += [(9, 1, p, 1, 1.0, 1000.0 + p, dt.date(2000, 1, 1), "A", "F") for p in range(1, 50)]
    got = {(r.symbol, r.session): (r.open, r.close, r.trades) for r in t.bars(spark, lines(spark, rows, tmp_path), grain, index=False).collect()}
    start = {"day": lambda d: d, "week": lambda d: d - dt.timedelta(d.weekday()), "month": lambda d: d.replace(day=1),
             "quarter": lambda d: d.replace(month=d.month - (d.month - 1) % 3, day=1), "year": lambda d: d.replace(month=1, day=1)}[grain]
    bars = {}
    for r in rows:
        bars.setdefault((f"S{r[3]}", start(r[6])), []).append(r)
    assert set(got) == set(bars)
    for key, group in bars.items():
        low, high = min(map(rank, group)), max(map(rank, group))
        assert got[key][0] in [r[5] for r in group if rank(r) == low] and got[key][1] in [r[5] for r in group if rank(r) == high]
        assert got[key][2] == len(group)


def test_bars_are_hash_aggregated(spark):
    plan = t.bars(spark, "/root/testdata/sf0.001", "quarter", index=False)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Sort " not in plan


def test_every_source_of_quarters_has_bars(spark):
    for status in "FO":
        b = t.sourced_bars(spark, "/root/testdata/sf0.01", status)
        assert b.where(F.col("open").isNull() | F.col("close").isNull()).count() == 0 and b.count() > 0


def test_part_keys_far_apart_order_equal_lines(spark, tmp_path):
    parts = [(1, 1_000_005), (99_998, 100_001), (99_999, 99_998 + 99_999), (None, 2_000_000)]
    rows = [(7, 1, p, k + 1, 1.0, float(p or 0), dt.date(2001, 1, 1), "A", "F") for k, pair in enumerate(parts) for p in pair]
    got = {r.symbol: (r.open, r.close) for r in t.bars(spark, lines(spark, rows, tmp_path), index=False).collect()}
    assert got == {"S1": (1.0, 1_000_005.0), "S2": (99_998.0, 100_001.0), "S3": (99_999.0, 199_997.0), "S4": (2_000_000.0, 0.0)}
