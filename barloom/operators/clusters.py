"""Correlation clusters of a whole universe by average linkage.

Two names can only share an average-linkage cluster cut at height h if a chain
of pairs each within h joins them: a merge at average distance h needs one pair
at most that far apart. So the universe splits exactly into the components of
the graph of close pairs. Close pairs are found block by block, the components
by label propagation, and linkage then runs inside each component only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import frames as W
from ..functions.scalars import truth
from ..session import cut_lineage

# Default look-back, correlation threshold and completeness floors.
LOOKBACK, THRESHOLD, MIN_OVERLAP, COMPLETENESS, MIN_NAMES = 250, 0.5, 200, 0.98, 3
#: Names whose distance matrix one task holds (32 MB); larger components are linked by rounds over rows.
ONE_TASK = 2000
BLOCK = 256


def measured_names(panel: DataFrame, as_of=None, lookback: int = LOOKBACK, completeness: float = COMPLETENESS,
                   min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """One row per name of the window: symbol, v (standardised returns, null if left out), reason, n_obs.

    ``n_obs`` counts the sessions in which all names with enough prices traded;
    only these enter, so that the correlations belong to one matrix. Returns are
    never taken across a gap.
    """
    p = panel if as_of is None else panel.where(F.col("session") <= F.lit(as_of).cast("date"))
    T = p.agg(F.max("idx")).scalar()
    p = p.where(F.col("idx") > T - lookback)
    lo = p.agg(F.min("idx")).scalar()
    r = cut_lineage(p.withColumn("r", F.col("close") / F.nullif(W.shift("close"), F.lit(0.0)) - 1.0).select("symbol", "idx", "r"))
    need = F.greatest(F.round(completeness * (T - lo)), F.lit(MIN_NAMES))
    have = cut_lineage(r.groupBy("symbol").agg((F.count("r") >= need).alias("enough")))
    r = r.where("r IS NOT NULL").join(have.where("enough").select("symbol"), "symbol")
    names = have.agg(F.count_if("enough")).scalar()
    full = r.groupBy("idx").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == names).select("idx")
    n_obs = full.agg(F.count(F.lit(1))).scalar()
    g = r.join(full, "idx").groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "r"))), lambda x: x["r"]).alias("v"),
                                                  F.stddev_pop("r").alias("sd"), F.avg("r").alias("m"))
    d = cut_lineage(have.join(g, "symbol", "left").withColumns({"names": names, "n_obs": n_obs}))
    moving = d.agg(F.count_if(F.col("sd") > 0)).scalar()
    reason = (F.when(F.col("names") < MIN_NAMES, "too few names with enough prices").when(F.col("n_obs") < min_overlap, "too few sessions in which all names traded")
              .when(~F.col("enough"), "too few prices in the window").when(~truth(F.col("sd") > 0), "the price did not move")
              .when(moving < MIN_NAMES, "too few names whose price moved"))
    d = d.withColumn("reason", reason)
    v = F.transform("v", lambda x: (x - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0)))
    return d.select("symbol", F.when(F.col("reason").isNull(), v).alias("v"), "reason", F.col("n_obs").cast("long").alias("n_obs"))


def return_vectors(panel: DataFrame, as_of=None, lookback: int = LOOKBACK, completeness: float = COMPLETENESS,
                   min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """(symbol, v) of the names that can be clustered."""
    return measured_names(panel, as_of, lookback, completeness, min_overlap).where("v IS NOT NULL").select("symbol", "v")


def shrunk(corr, delta: float):
    """Correlations of different names drawn towards none by the share ``delta``."""
    return (1.0 - delta) * corr


def _blocks_met(vectors: DataFrame, block: int, *beside: str) -> DataFrame:
    """Every pair of hashed blocks (i, j) with the names of both."""
    n = vectors.agg(F.count(F.lit(1))).scalar()
    blocks = F.ceil(n / block)
    v = vectors.withColumn("b", F.pmod(F.xxhash64("symbol"), blocks))
    return v.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select(
        F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "symbol", "v", *beside)


def close_pairs(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, delta: float = 0.0) -> DataFrame:
    """Pairs with (shrunk) correlation at or above the threshold.

    Names are hashed to blocks and each block meets each other block in one
    matrix product; only pairs over the threshold leave the task, so neither all
    pairs nor the correlation matrix is ever materialised.
    """

    def product(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        a, c = g[g["b"] == i], g[g["b"] == j]
        if a.empty or c.empty:
            return pd.DataFrame({"a": [], "z": [], "corr": []})
        A, C = np.vstack(a["v"].to_numpy()), np.vstack(c["v"].to_numpy())
        corr = shrunk(A @ C.T / A.shape[1], delta)
        x, y = np.nonzero(corr >= threshold - 1e-9)
        out = pd.DataFrame({"a": a["symbol"].to_numpy()[x], "z": c["symbol"].to_numpy()[y], "corr": corr[x, y]})
        out = out[out["a"] != out["z"]]
        lo, hi = out[["a", "z"]].min(axis=1), out[["a", "z"]].max(axis=1)
        return out.assign(a=lo, z=hi).drop_duplicates(["a", "z"])

    return _blocks_met(vectors, block).groupBy("i", "j").applyInPandas(product, "a string, z string, corr double")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable name per node, by propagation with label shortcuts."""
    both = cut_lineage(edges.select("a", "z").unionByName(edges.select(F.col("z").alias("a"), F.col("a").alias("z"))))
    lab = cut_lineage(nodes.select("symbol", F.col("symbol").alias("label")))
    while True:  # a round that changes nothing ends it
        near = both.join(lab.withColumnRenamed("symbol", "z"), "z").groupBy(F.col("a").alias("symbol")).agg(F.min("label").alias("m"))
        step = lab.join(near, "symbol", "left").select("symbol", "label", F.least("label", "m").alias("new"))
        hop = step.select(F.col("symbol").alias("new"), F.col("new").alias("far"))
        step = cut_lineage(step.join(hop, "new", "left").select("symbol", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        if step.where("new < label").isEmpty():
            return step.select("symbol", F.col("new").alias("label"))
        lab = step.select("symbol", F.col("new").alias("label"))


def _average_linkage(D: np.ndarray, cut: float) -> np.ndarray:
    """Cluster ids at ``cut``: nearest pair merges while its mean distance fits."""
    n = len(D)
    D = D.copy()
    np.fill_diagonal(D, np.inf)
    size, owner = np.ones(n), np.arange(n)
    while True:
        k = int(np.argmin(D))
        i, j = divmod(k, n)
        if not D[i, j] <= cut:
            return owner
        merged = (size[i] * D[i] + size[j] * D[j]) / (size[i] + size[j])
        D[i], D[:, i] = merged, merged
        D[i, i] = np.inf
        D[j], D[:, j] = np.inf, np.inf
        size[i] += size[j]
        owner[owner == j] = i


def _distances(V: np.ndarray, U: np.ndarray, delta: float) -> np.ndarray:
    return np.sqrt(np.clip((1.0 - shrunk(V @ U.T / V.shape[1], delta)) / 2.0, 0.0, 1.0))


def _linked_by_rounds(members: DataFrame, cut: float, delta: float, block: int) -> DataFrame:
    """(symbol, head) of the members (symbol, v, label) of large components.

    The smallest name stands for a cluster. Rows (a, z, sum, n) hold the distances
    between the names of two clusters; mutual nearest clusters within ``cut``
    merge, the nearest by (mean, names), until no two are that near.
    """

    def product(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        a, c = g[g["b"] == i], g[g["b"] == j]
        if a.empty or c.empty:
            return pd.DataFrame({"a": [], "z": [], "sum": [], "n": []})
        d = _distances(np.vstack(a["v"].to_numpy()), np.vstack(c["v"].to_numpy()), delta)
        s, t = a["symbol"].to_numpy(), c["symbol"].to_numpy()
        x, y = np.nonzero((a["label"].to_numpy()[:, None] == c["label"].to_numpy()[None, :]) & ((s[:, None] < t[None, :]) | (i != j)) & (s[:, None] != t[None, :]))
        first = s[x] < t[y]
        return pd.DataFrame({"a": np.where(first, s[x], t[y]), "z": np.where(first, t[y], s[x]), "sum": d[x, y], "n": 1})

    rows = cut_lineage(_blocks_met(members, block, "label").groupBy("i", "j").applyInPandas(product, "a string, z string, sum double, n long"))
    owner = cut_lineage(members.select("symbol", F.col("symbol").alias("head")))
    while True:
        near = rows.select("a", "z", (F.col("sum") / F.col("n")).alias("mean")).where(F.col("mean") <= cut)
        pick = F.min(F.struct("mean", "a", "z")).alias("m")
        best = near.groupBy(F.col("a").alias("who")).agg(pick).unionByName(near.groupBy(F.col("z").alias("who")).agg(pick)).groupBy("who").agg(F.min("m").alias("m"))
        merged = cut_lineage(best.groupBy(F.col("m.a").alias("to"), F.col("m.z").alias("gone")).agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("to", "gone"))
        if merged.isEmpty():
            return owner
        now = lambda c: F.coalesce("to", c)
        moved = rows.join(merged, F.col("a") == F.col("gone"), "left").select(now("a").alias("a"), "z", "sum", "n")
        moved = moved.join(merged, F.col("z") == F.col("gone"), "left").select("a", now("z").alias("z"), "sum", "n").where("a <> z")
        rows = cut_lineage(moved.groupBy(F.least("a", "z").alias("a"), F.greatest("a", "z").alias("z")).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")))
        owner = cut_lineage(owner.join(merged, F.col("head") == F.col("gone"), "left").select("symbol", now("head").alias("head")))


def cluster_map(vectors: DataFrame, threshold: float = THRESHOLD, delta: float = 0.0, one_task: int = ONE_TASK, block: int = BLOCK) -> DataFrame:
    """Label per name: ``CORR:first+others``; a name alone keeps its own. ``delta`` shrinks the correlations first."""
    vectors = cut_lineage(vectors)
    comp = components(vectors, close_pairs(vectors, threshold, block, delta))
    cut = float(np.sqrt((1.0 - threshold) / 2.0))

    def link(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("symbol", ignore_index=True)
        V = np.vstack(g["v"].to_numpy())
        return pd.DataFrame({"symbol": g["symbol"], "head": g["symbol"].to_numpy()[_average_linkage(_distances(V, V, delta), cut)]})

    count = comp.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    placed = cut_lineage(vectors.join(comp.join(count, "label"), "symbol"))
    heads = placed.where(F.col("members") <= one_task).select("symbol", "v", "label").groupBy("label").applyInPandas(link, "symbol string, head string")
    large = placed.where(F.col("members") > one_task).select("symbol", "v", "label")
    if not large.isEmpty():
        heads = heads.unionByName(_linked_by_rounds(large, cut, delta, block))
    named = heads.groupBy("head").agg(F.min("symbol").alias("first"), F.count(F.lit(1)).alias("n"))
    label = F.when(F.col("n") == 1, F.concat(F.lit("CORR:"), "first")).otherwise(F.concat(F.lit("CORR:"), "first", F.lit("+"), (F.col("n") - 1).cast("string")))
    return heads.join(named, "head").select("symbol", label.alias("label"))


def clusters(panel: DataFrame, as_of=None, lookback: int = LOOKBACK, threshold: float = THRESHOLD, completeness: float = COMPLETENESS,
             min_overlap: int = MIN_OVERLAP, delta: float = 0.0) -> DataFrame:
    """symbol, label, reason, n_obs of every name of the window: a label, or the reason why it has none."""
    names = cut_lineage(measured_names(panel, as_of, lookback, completeness, min_overlap))
    labels = cluster_map(names.where("v IS NOT NULL").select("symbol", "v"), threshold, delta)
    return names.select("symbol", "reason", "n_obs").join(labels, "symbol", "left").select("symbol", "label", "reason", "n_obs")


def collisions(shortlist: DataFrame, labels: DataFrame, by: str = "session") -> DataFrame:
    """Per ``by``: shortlisted names, those without a label, and whether two of them share one."""
    d = shortlist.join(labels.select("symbol", "label"), "symbol", "left")
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("names"), F.count_if(F.col("label").isNull()).alias("unplaced"),
                             (F.count("label") > F.count_distinct("label")).alias("collides"))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("members")).where("members > 1")


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two labelings from their contingency counts."""
    j = a.select("symbol", F.col("label").alias("la")).join(b.select("symbol", F.col("label").alias("lb")), "symbol")
    c2 = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    count = lambda *k: j.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(c2("n")))
    total = j.agg(F.count(F.lit(1)).alias("n")).select(c2("n").alias("t"))
    d = total.withColumns({"ij": count("la", "lb").scalar(), "i": count("la").scalar(), "j": count("lb").scalar()})
    exp = F.col("i") * F.col("j") / F.nullif(F.col("t"), F.lit(0.0))
    return d.select(((F.col("ij") - exp) / F.nullif((F.col("i") + F.col("j")) / 2 - exp, F.lit(0.0))).alias("ari"))
