"""Headline timings on local cores; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores. Bars are first written to a session-partitioned store,
as a user would hold them; every timed query then reads that store or the given
tables. A query is run to completion (all columns, through a no-op sink) three
times and its best time counts; the first run is the warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Window, functions as F  # noqa: E402

from barloom.operators import clusters, features, fundamentals, indicators, outcomes, panel, presets, quality, ranking, regime  # noqa: E402
from barloom.plans import gates, tables  # noqa: E402
from barloom.session import build_session, cut_lineage  # noqa: E402


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")

    weekly = cut_lineage(tables.bars(spark, sf, "week"))
    daily = cut_lineage(tables.bars(spark, sf, "day"))
    store = tempfile.mkdtemp(prefix="spark-") + "/bars"
    weekly.drop("idx").repartition("session").write.partitionBy("session").parquet(store)
    bars = spark.read.parquet(store)
    bench = cut_lineage(weekly.groupBy("session").agg(F.avg("close").alias("bench")))
    feats = cut_lineage(features.stage1(weekly, benchmark=bench).withColumn("session", F.lit("2001-06-01").cast("date")))
    acts = cut_lineage(gates.actions(spark, sf))
    rows = dict(weekly=weekly.count(), daily=daily.count())
    filings = cut_lineage(tables.filings(spark, sf))
    grid = [dict(stop_pct=float(s), rr=2.0, hold=10) for s in (5, 10, 20, 40)]

    runs = {
        "build_weekly_bars": lambda: tables.bars(spark, sf, "week"),
        "history_load": lambda: panel.history(bars, "2001-06-01", lookback=215, columns=["open", "high", "low", "close", "volume"]),
        "stage1_features": lambda: features.stage1(weekly, benchmark=bench),
        "stage1_features_daily": lambda: features.stage1(daily),
        "stage2_ranking": lambda: ranking.stage2(feats, ranking.REVERSAL_FACTORS, flagged_only=False),
        "universe_quality": lambda: quality.check_panel(weekly, acts),
        "back_adjustment": lambda: quality.adjust(daily, acts),
        "indicator_set": lambda: indicators.adx(indicators.rsi(indicators.macd(
            indicators.atr(weekly)))).withColumns(
            {**indicators.bollinger(), **indicators.donchian(20), "k": indicators.stochastic_k()}),
        "outcome_sweep": lambda: outcomes.lattice(weekly, grid),
        "preset_signals": lambda: presets.signals(weekly, presets.RULES["donchian_breakout"]),
        "market_regime": lambda: regime.regime_series(weekly),
        "latest_filings": lambda: fundamentals.latest_filing(filings, "1998-05-10"),
        "fundamentals_table": lambda: fundamentals.build_table(filings, "1998-05-10"),
        "correlation_clusters": lambda: clusters.cluster_map(clusters.return_vectors(weekly, lookback=60, completeness=0.7, min_overlap=1)),
    }
    only = set(sys.argv[1:])
    took = {}
    for name, build in runs.items():
        if only and name not in only:
            continue
        best = None
        for _ in range(3):
            t = time.perf_counter()
            drain(build())
            s = time.perf_counter() - t
            best = s if best is None else min(best, s)
        took[name] = round(best, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": Path(sf).name.removeprefix("sf"), "rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
