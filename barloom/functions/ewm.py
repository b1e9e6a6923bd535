"""Exponential smoothing as running sums, entirely in the JVM.

The recursion ``y = w*y' + (1-w)*x`` with ``w = (1-a)^k / ((1-a)^k + a)`` (k
sessions since the previous value; w = 1-a when there is no gap) unrolls to

    y_t = exp(L_t) * sum_{i<=t} c_i * exp(-L_i),   L_t = sum_{i<=t} ln w_i

with ``c`` the first value or ``(1-w) x``. Both sums are running window sums,
constant work per row, so no Python and no per-symbol array fold is needed. To
keep exp(-L) inside a double the series is cut into blocks of sessions. L starts
at 0 at the first value of a block, however long the gap before it: the fade of
that value multiplies what the block takes over, not the sums. What a block
takes over is folded exactly over the ends of all blocks before it, a handful
per symbol: only a block's last row is kept for that.

All windows of a pass stand in one order (symbol, block, session), so a pass is
one sort and four windows: the previous value, L, the sum, the block ends.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .frames import AT, BY
from .scalars import col

_SPAN = 600.0  # natural-log range one block may cover


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def wilder_alpha(n: int) -> float:
    return 1.0 / n


def _taken_over(name: str):
    def step(value, end):
        return end[name]["own"] + end[name]["keeps"] * value

    return step


def ewm(df: DataFrame, specs: dict[str, tuple], by=BY, at=AT, hold: bool = False) -> DataFrame:
    """Add one smoothed column per entry ``out: (column, alpha)``.

    NULL inputs keep the previous smoothed value and widen the next gap. With
    ``hold`` the input is itself a carried quantity (a smoothed value keeps its
    level over untraded sessions), so those sessions repeat its last value.
    """
    keys = [by] if isinstance(by, str) else list(by)
    rate = max(-math.log1p(-a) for _, a in specs.values())
    size = int(_SPAN / rate)

    df = df.withColumn("__blk", F.floor(F.col(at) / size))
    line = Window.partitionBy(*keys).orderBy("__blk", at)
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*keys, "__blk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)

    steps = {"__end": F.lead("__blk").over(line) != F.col("__blk")}
    for out, (c, _) in specs.items():
        steps[f"__p_{out}"] = F.last(F.when(col(c).isNotNull(), F.col(at)), ignorenulls=True).over(past)
        if hold:
            steps[f"__v_{out}"] = F.last(col(c), ignorenulls=True).over(past)
    df = df.withColumns(steps)

    weights, sums = {}, {}
    for out, (c, a) in specs.items():
        x, p = col(c), F.col(f"__p_{out}")
        k = (F.col(at) - p).cast("double")
        d = F.exp(k * math.log1p(-a))
        live = x.isNotNull() & p.isNotNull()
        if hold:
            fade, fresh = k * math.log1p(-a), a * x + ((1 - a) - d) * F.col(f"__v_{out}")
        else:
            fade, fresh = k * math.log1p(-a) - F.log(d + a), x * a / (d + a)
        weights[f"__w_{out}"] = F.when(live, fade).otherwise(0.0)
        weights[f"__c_{out}"] = F.when(live, fresh).when(x.isNotNull(), x).otherwise(0.0)
        # the first value of its block: its fade belongs to what the block takes over
        weights[f"__h_{out}"] = live & (F.floor(p / size) != F.col("__blk"))
        sums[f"__l_{out}"] = F.sum(F.when(F.col(f"__h_{out}"), 0.0).otherwise(F.col(f"__w_{out}"))).over(run)
        sums[f"__f_{out}"] = F.sum(F.when(F.col(f"__h_{out}"), F.col(f"__w_{out}")).otherwise(0.0)).over(run)
    df = df.withColumns(weights).withColumns(sums)
    df = df.withColumns({f"__s_{o}": F.sum(F.col(f"__c_{o}") * F.exp(-F.col(f"__l_{o}"))).over(run) for o in specs})

    ends = F.struct(*[F.struct((F.exp(F.col(f"__l_{o}")) * F.col(f"__s_{o}")).alias("own"),
                               F.exp(F.col(f"__l_{o}") + F.col(f"__f_{o}")).alias("keeps")).alias(f"e{i}") for i, o in enumerate(specs)])
    df = df.withColumn("__ends", F.collect_list(F.when(F.col("__end"), ends)).over(past))

    outs = {}
    for i, (out, (c, _)) in enumerate(specs.items()):
        taken = F.aggregate("__ends", F.lit(0.0), _taken_over(f"e{i}"))
        started = col(c).isNotNull() | F.col(f"__p_{out}").isNotNull()
        carried = F.when(F.size("__ends") > 0, F.exp(F.col(f"__l_{out}") + F.col(f"__f_{out}")) * taken).otherwise(0.0)
        outs[out] = F.when(started, F.exp(F.col(f"__l_{out}")) * F.col(f"__s_{out}") + carried)
    df = df.withColumns(outs)
    return df.drop(*[n for n in df.columns if n.startswith("__")])
