"""Stage 2: cross-sectional percentile ranks folded into one score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.ranks import group_rank_pct
from ..functions.scalars import base_symbol, truth
from ..session import cut_lineage


@dataclass(frozen=True)
class Factor:
    name: str
    column: str
    direction: int
    weight: float
    hostile: tuple[str, ...] = ()

    def __post_init__(self):
        if self.direction not in (1, -1) or self.weight <= 0:
            raise ValueError(f"{self.name}: direction is +1 or -1, weight positive")


# The three factor sets.
DEFAULT_FACTORS = (
    Factor("momentum", "ret_20d_pct", 1, 1.0, ("crisis",)),
    Factor("trend", "dist_sma50_pct", 1, 1.0, ("crisis",)),
    Factor("range_position", "pos_52w_pct", 1, 0.75, ("crisis",)),
    Factor("participation", "rel_volume", 1, 0.5),
    Factor("calmness", "atr_pct_rank", -1, 0.5),
)
FUNDAMENTAL_FACTORS = (
    Factor("revenue_growth", "revenue_growth_yoy_pct", 1, 1.0),
    Factor("profit_growth", "profit_growth_yoy_pct", 1, 1.0),
    Factor("margin_trend", "margin_change_pp", 1, 0.75),
)
REVERSAL_FACTORS = (
    Factor("reversal", "ret_5d_pct", -1, 1.0, ("crisis",)),
    Factor("quiet_participation", "rel_volume", -1, 1.0),
    Factor("calmness", "atr_pct_rank", -1, 0.75),
)


def active_factors(df: DataFrame, factors, regime: str = "unknown") -> list[Factor]:
    """Factors that may speak: not hostile to the regime and present as a column.

    A factor that is NULL for the whole universe needs no test here: it yields
    no rank for anyone and drops out of every weighted mean.
    """
    return [f for f in factors if regime not in f.hostile and f.column in df.columns]


def factor_status(df: DataFrame, factors, regime: str = "unknown") -> DataFrame:
    """Why each factor ran or stayed silent: one aggregate over the universe."""
    present = {f.column for f in factors if f.column in df.columns}
    counts = df.agg(*[F.count(c).alias(c) for c in sorted(present)]) if present else df.agg(F.count(F.lit(1)).alias("n"))
    rows = [F.struct(F.lit(f.name).alias("factor"), F.lit(f.weight).alias("weight"),
                     F.lit(f"regime {regime} is hostile to it").alias("status") if regime in f.hostile
                     else F.lit("column is absent").alias("status") if f.column not in present
                     else F.when(F.col(f.column) == 0, "no values in this universe").otherwise("active").alias("status"))
            for f in factors]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def stage2(features: DataFrame, factors=DEFAULT_FACTORS, regime: str = "unknown", min_factors: int = 3,
           extended_penalty: float = 15.0, flagged_only: bool = True, keys=("session",)) -> DataFrame:
    """Score 0..100 per name with its factor ranks.

    All factors are ranked together in long form, so their number does not add
    shuffles; see ``group_rank_pct`` for how a large universe is ranked. The
    long form is stored first: ranking reads it more than once, and behind it
    stands the whole feature computation.
    """
    keys = list(keys)
    src = features.where("flag_count > 0") if flagged_only else features
    use = active_factors(src, factors, regime)
    if not use:
        raise ValueError(f"no factor can run in regime {regime}")
    long = src.select(*keys, "symbol", "extended", F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("factor"), F.lit(f.weight).alias("weight"),
                 (f.direction * F.col(f.column)).cast("double").alias("v")) for f in use])).alias("f")
    ).select(*keys, "symbol", "extended", "f.*")
    long = cut_lineage(long)
    ranked = group_rank_pct(long, keys + ["factor"], "v", "rank", scale=100.0)
    rank = lambda f: F.max(F.when(F.col("factor") == f.name, F.col("rank")))
    # added up in the order of the factors: a sum over rows takes them as they come
    score = (sum((F.coalesce(rank(f) * f.weight, F.lit(0.0)) for f in use[1:]), F.coalesce(rank(use[0]) * use[0].weight, F.lit(0.0)))
             / F.sum(F.when(F.col("rank").isNotNull(), F.col("weight"))))
    penalty = F.max(F.when(truth(F.col("extended")), extended_penalty).otherwise(0.0))
    out = ranked.groupBy(*keys, "symbol").agg(
        score.alias("raw"), F.count("rank").alias("factors_used"), penalty.alias("penalty"),
        *[rank(f).alias(f"rank_{f.name}") for f in use])
    return (out.where(F.col("factors_used") >= min_factors)
            .withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("raw") - F.col("penalty"))))
            .drop("raw"))


def explain(ranked: DataFrame, factors) -> DataFrame:
    """Long form of a score: one row per symbol and factor that contributed."""
    cols = [f for f in factors if f"rank_{f.name}" in ranked.columns]
    return ranked.select("symbol", "score", F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("factor"), F.col(f"rank_{f.name}").alias("percentile"),
                 F.lit(f.weight).alias("weight"),
                 F.lit("higher" if f.direction > 0 else "lower").alias("better")) for f in cols])).alias("e")
    ).select("symbol", "score", "e.*")


def apply_fundamentals(features: DataFrame, table: DataFrame, max_age_days: int | None = None,
                       min_margin: float | None = None) -> DataFrame:
    """Left join on the base symbol, then the hard filters.

    A name without a filing passes (it was not checked); ``checked`` says so.
    On duplicate base symbols the first full symbol in order wins.
    """
    right = (table.withColumn("base", base_symbol("symbol"))
             .groupBy("base").agg(F.min_by(F.struct(*[c for c in table.columns if c != "symbol"]),
                                           F.col("symbol")).alias("r")).select("base", "r.*"))
    out = features.withColumn("base", base_symbol("symbol")).join(right, "base", "left")
    out = out.withColumn("checked", F.col("period_end").isNotNull())
    if max_age_days is not None:
        out = out.where(~truth(F.col("days_since_filing") > max_age_days))
    if min_margin is not None:
        out = out.where(~truth(F.col("net_margin_pct") < min_margin))
    return out.drop("base")
