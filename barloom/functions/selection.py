"""Exact quantiles of groups that may be too large for one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def join_on(left: DataFrame, right: DataFrame, keys: list[str], extra: Column | None = None, how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; keys are equal, null with null, and stay once."""
    marked = right.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(keys)])
    return left.join(marked, on if extra is None else on & extra, how).drop(*[f"__j{i}" for i in range(len(keys))])


def group_quantiles(df: DataFrame, keys, value: str, shares: dict[str, float], buckets: int = 64) -> DataFrame:
    """One row per group: ``keys`` and for each ``name: share`` the quantile, interpolated between neighbours.

    Equal values of a group are one row with a count, so a tie that a third of
    the table shares is one row. Approximate quantiles cut a group into value
    ranges whose exact counts tell in which of them each wanted rank falls; only
    those ranges are put in order. The cuts steer where work lands, and any cut
    gives the same result; they are stored, since computed again they may differ.
    Null values are left out; a group of nulls has no row.
    """
    names = [f"__g{i}" for i in range(max(1, len(keys)))]
    key_cols = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias(names[0])]
    rows = df.where(F.col(value).isNotNull()).select(*key_cols, F.col(value).cast("double").alias("__v"))
    counts = cut_lineage(rows.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__n")))
    cuts = cut_lineage(counts.groupBy(*names).agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 1000).alias("__cuts")))
    binned = join_on(counts, cuts, names).select(*names, "__v", "__n", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__b"))
    group = Window.partitionBy(*names)
    bins = binned.groupBy(*names, "__b").agg(F.sum("__n").alias("__size"))
    bins = bins.withColumns({"__off": F.coalesce(F.sum("__size").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                             "__all": F.sum("__size").over(group)})
    asked = []
    for which, share in enumerate(shares.values()):
        at = F.lit(float(share)) * (F.col("__all") - 1)
        asked += [F.struct(F.lit(2 * which).alias("which"), F.floor(at).alias("rank")), F.struct(F.lit(2 * which + 1).alias("which"), F.ceil(at).alias("rank"))]
    wanted = (bins.select(*names, "__b", "__off", "__size", F.explode(F.array(*asked)).alias("__w"))
              .where((F.col("__w.rank") >= F.col("__off")) & (F.col("__w.rank") < F.col("__off") + F.col("__size")))
              .select(*names, "__b", F.col("__w.which").alias("__which"), (F.col("__w.rank") - F.col("__off")).alias("__rank")))
    place = names + ["__b"]
    need = wanted.select(*place).distinct()
    inside = Window.partitionBy(*place).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    run = join_on(binned, need, place).withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    hit = (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n"))
    found = join_on(run, wanted, place, hit).select(*names, "__which", "__v")
    sizes = bins.groupBy(*names).agg(F.max("__all").alias("__all"))
    picked = found.groupBy(*names).agg(*[F.max(F.when(F.col("__which") == j, F.col("__v"))).alias(f"__q{j}") for j in range(2 * len(shares))])
    out = join_on(picked, sizes, names)
    cols = []
    for which, (name, share) in enumerate(shares.items()):
        at = F.lit(float(share)) * (F.col("__all") - 1)
        low, high = F.col(f"__q{2 * which}"), F.col(f"__q{2 * which + 1}")
        cols.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *cols)


def with_quantiles(summary: DataFrame, df: DataFrame, keys, value: str, shares: dict[str, float]) -> DataFrame:
    """``summary`` (one row per ``keys``) with the quantiles of ``value`` in ``df`` beside it."""
    keys = list(keys)
    q = group_quantiles(df, keys, value, shares)
    if not keys:
        return summary.join(q, F.lit(True), "left")  # one row each
    return join_on(summary, q, keys, how="left")


# ---- order inside a group that may be too large for one task ----------------

def order_code(df: DataFrame, column: str) -> Column:
    """A number that grows with the column: strings by their first seven bytes, numbers as they are."""
    if dict(df.dtypes)[column] == "string":
        first = F.rpad(F.substring(F.hex(F.encode(F.col(column), "UTF-8")), 1, 14), 14, "0")
        return F.conv(first, 16, 10).cast("double")
    return F.col(column).cast("double")


def with_stretch(df: DataFrame, column: str, out: str = "__stretch", stretches: int = 64) -> DataFrame:
    """``out``: which of about ``stretches`` value ranges of ``column`` a row falls into, in its order, nulls first.

    The cuts are quantiles of the whole table, ``stretches`` numbers that are fetched
    first. Rows of a group that is ordered by ``column`` first can then be numbered
    or summed range by range.
    """
    d = df.withColumn("__code", order_code(df, column))
    cuts = d.agg(F.percentile_approx("__code", [i / stretches for i in range(1, stretches)], 1000)).first()[0] or []
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda c: c < F.col("__code")))
    return d.withColumn(out, F.when(F.col("__code").isNull(), -1).otherwise(at)).drop("__code")
