"""Seeded resampling without a driver-side generator.

A draw is the hash of its own coordinates (seed, path, position). It does not
depend on partitioning or task retries, so a lost executor re-derives the same
sample and two runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.selection import with_quantiles, with_stretch
from ..session import cut_lineage
from .outcomes import sequential_sums


def draw_key(seed: int, *parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                                                      for p in parts]))


def uniform(seed: int, *parts) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the draw key."""
    return F.conv(F.substring(draw_key(seed, *parts), 1, 8), 16, 10).cast("double") / 4294967296.0


def permuted_signals(signals: DataFrame, n_sessions: Column, n_perm: int, seed: int) -> DataFrame:
    """Each symbol's signals moved to random sessions, once per permutation.

    A symbol with m signals gets the m sessions of lowest hash. Only symbols
    that signal at all are expanded, and (symbol, perm) is the unit of work.
    """
    m = signals.groupBy("symbol").agg(F.count(F.lit(1)).alias("m"))
    cells = (m.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
             .withColumn("idx", F.explode(F.sequence(F.lit(0), (n_sessions - 1).cast("int")))))
    order = Window.partitionBy("symbol", "perm").orderBy(draw_key(seed, "perm", "symbol", "idx"), "idx")
    return (cells.withColumn("rn", F.row_number().over(order)).where("rn <= m")
            .select("symbol", "perm", "idx"))


def timing_test(signals: DataFrame, lattice: DataFrame, n_sessions: Column, cost_r: float = 0.0,
                n_perm: int = 500, seed: int = 7) -> DataFrame:
    """Do the signal dates matter? One row: observed mean R against shuffles.

    ``lattice`` holds one outcome per (symbol, idx) and is reused by every
    permutation.
    """
    lat = lattice.select("symbol", "idx", "exit_at", "r")
    moved = permuted_signals(signals, n_sessions, n_perm, seed)
    every = signals.select("symbol", F.lit(0).alias("perm"), "idx").unionByName(moved.select("symbol", "perm", "idx"))
    per_key = sequential_sums(every.join(lat, ["symbol", "idx"]), ["perm", "symbol"])
    runs = (per_key.groupBy("perm").agg(F.sum("sum_r").alias("s"), F.sum("trades").alias("n"))
            .where("n > 0").withColumn("mean_r", F.col("s") / F.col("n") - cost_r))
    obs = F.max(F.when(F.col("perm") == 0, F.col("mean_r"))).over(Window.partitionBy())
    runs = runs.withColumn("obs", obs)   # one row per permutation
    null = F.when(F.col("perm") > 0, F.col("mean_r"))
    return runs.agg(F.max("obs").alias("observed"), F.avg(null).alias("null_mean"),
                    F.stddev_pop(null).alias("null_std"),
                    ((F.count_if(null >= F.col("obs")) + 1) / (F.count(null) + 1)).alias("p_value"),
                    F.count(null).alias("n_permutations"),
                    F.max(F.when(F.col("perm") == 0, F.col("n"))).alias("n_trades"),
                    (100.0 * F.try_divide(F.count_if(null < F.col("obs")), F.count(null))).alias("percentile"))


def numbered(trades: DataFrame, session: str, *tie) -> DataFrame:
    """Global position by (session, tie...) without one global sort task.

    Rows are counted per stretch (a value range of the first tie column inside a
    session), the counts are accumulated over sessions and stretches, and rows
    are numbered inside their stretch; a session with most of the rows is many.
    The trades are stored first: the cuts, the counts and the numbers read them.
    """
    t = with_stretch(cut_lineage(trades), tie[0])
    unit = [session, "__stretch"]
    per = t.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)  # at most 65 rows a session
    off = per.select(*unit, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy(*unit).orderBy(*tie))
    return (t.withColumn("__i", inside).join(off, unit)
            .withColumn("pos", F.col("__off") + F.col("__i") - 1).drop("__off", "__i", "__stretch"))


def bootstrap_paths(sequence: DataFrame, n_trades: int = 200, n_paths: int = 2000, block: int = 20,
                    risk_pct: float = 1.0, seed: int = 7, iid: bool = False) -> DataFrame:
    """Compounded equity paths from resampled blocks of an R sequence (pos, r).

    Block starts are hashed draws over the valid starts; each step then meets its R
    through a join on position. Per path: final growth and deepest drawdown.
    """
    size = 1 if iid else block
    n = sequence.agg(F.count(F.lit(1))).scalar()
    size_c = F.least(F.lit(size).cast("long"), n)
    per_path = -(-n_trades // size)
    spark = sequence.sparkSession
    starts = (spark.range(n_paths).withColumnRenamed("id", "path")
              .withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(per_path - 1))))
              .withColumn("start", F.floor(uniform(seed, "path", "blk") * (n - size_c + 1))))
    steps = (starts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
             .select("path", (F.col("blk") * size + F.col("j")).alias("t"),
                     (F.col("start") + F.col("j")).alias("pos")).where(F.col("t") < n_trades))
    grown = steps.join(sequence.select("pos", "r"), "pos").withColumn(
        "g", F.greatest(1.0 + risk_pct / 100.0 * F.col("r"), F.lit(0.01)))
    so_far = Window.partitionBy("path").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    eq = grown.withColumn("equity", F.exp(F.sum(F.log("g")).over(so_far)))
    eq = eq.withColumn("peak", F.greatest(F.max("equity").over(so_far), F.lit(1.0)))
    return eq.groupBy("path").agg(F.max_by("equity", "t").alias("final"),
                                  F.max(1.0 - F.col("equity") / F.col("peak")).alias("max_dd"))


def ruin_report(paths: DataFrame) -> DataFrame:
    paths = cut_lineage(paths)
    f, d = F.col("final"), F.col("max_dd")
    out = paths.agg(
        F.count(F.lit(1)).alias("n_paths"), F.avg((f < 1).cast("double")).alias("prob_loss"),
        F.avg((d > 0.2).cast("double")).alias("prob_drawdown_over_20"), F.avg((d > 0.35).cast("double")).alias("prob_drawdown_over_35"))
    out = with_quantiles(out, paths, (), "final", {"f50": 0.5, "f05": 0.05, "f95": 0.95})
    out = with_quantiles(out, paths, (), "max_dd", {"d50": 0.5, "d95": 0.95})
    gain = lambda c: 100 * (F.col(c) - 1)
    return out.select("n_paths", gain("f50").alias("median_return_pct"), gain("f05").alias("p5_return_pct"), gain("f95").alias("p95_return_pct"),
                      (100 * F.col("d50")).alias("median_max_drawdown_pct"), (100 * F.col("d95")).alias("p95_max_drawdown_pct"),
                      "prob_loss", "prob_drawdown_over_20", "prob_drawdown_over_35")


def trades_to_significance(mean, sd, t_target: float = 2.0) -> Column:
    m, s = F.col(mean), F.col(sd)
    return F.when((m > 0) & (s > 0), F.pow(t_target * s / m, F.lit(2.0)))
