"""Approximate nearest neighbours by collision counting over single projections.

Vectors are scaled to unit length and projected onto orthogonal random
directions; every direction keeps its own array of projections, sorted. A query
opens a window around its own projection in each array and counts in how many of
them a vector falls in. The windows grow with the search radius (virtual
rehashing: nothing is hashed again, a window only takes in the next rows on both
sides). A vector whose count passes the collision threshold is verified with its
exact cosine. The threshold is set so that a vector at the radius itself passes
with probability ``1 - MISS``, and the radius of a query stops growing once its
k-th best verified neighbour lies inside it.

The vectors are dealt into blocks, and so are the queries; a task holds one block
of each, builds the sorted arrays of its vectors and returns every query's best
of them. The best of all blocks together are the result.
"""

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import cut_lineage

PROJECTIONS = 64
#: Half width of a window at radius 1, in units of the projections' spread there, and the chance that a true neighbour is missed.
HALF_WIDTH, MISS = 1.0, 0.1
#: Squared chord lengths the radius grows through; 4 reaches the opposite pole, where every vector is in every window.
RADII = tuple(np.sqrt([0.05, 0.4, 0.8, 1.0, 1.15, 1.3, 1.6, 2.0, 4.0]))
BLOCK, QUERIES = 4096, 512
EVERY = 50


def directions(size: int, seed: int = 23) -> np.ndarray:
    """Orthonormal sets of random directions, PROJECTIONS in all, scaled so that a projection of a unit step has spread 1."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-PROJECTIONS // size))]
    return np.concatenate(sets, axis=1)[:, :PROJECTIONS] * math.sqrt(size)


def threshold() -> int:
    """Collisions that a vector at the radius has at least, but for a chance of MISS.

    Its projections differ from the query's by a normal deviate of the radius'
    spread, so each falls into the window with the same probability at every
    radius.
    """
    p = 2 * NormalDist().cdf(HALF_WIDTH) - 1
    least, below = 0, 0.0
    while True:
        below += math.comb(PROJECTIONS, least) * p ** least * (1 - p) ** (PROJECTIONS - least)
        if below > MISS:
            return least
        least += 1


class Block:
    """Sorted projections of unit vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.exact = ids, vectors
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.unit = unit
        proj = (unit @ directions(vectors.shape[1])).T
        order = np.argsort(proj, axis=1, kind="stable")
        self.sorted = np.take_along_axis(proj, order, 1)
        self.place = np.empty(proj.shape, np.uint16 if len(ids) < 65536 else np.uint32)  # of each vector in each array
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=self.place.dtype)[None, :], 1)
        self.least = threshold()

    def windows(self, projected: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """First place and width of every query's window in every array."""
        reach = HALF_WIDTH * radius
        low = np.stack([np.searchsorted(s, p - reach) for s, p in zip(self.sorted, projected.T)], axis=1)
        high = np.stack([np.searchsorted(s, p + reach, "right") for s, p in zip(self.sorted, projected.T)], axis=1)
        return low.astype(self.place.dtype), (high - low).astype(self.place.dtype)

    def search(self, owns: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
        """For each query the places of the best vectors found (4 k at most) and the number of vectors verified."""
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        projected = unit @ directions(queries.shape[1])
        out: list[tuple[np.ndarray, int]] = [(np.empty(0, np.int64), 0)] * len(owns)
        state = {q: (np.empty(0, np.int64), np.empty(0), self.ids == own, 0) for q, own in enumerate(owns.tolist())}
        for radius in RADII:
            active = np.array(sorted(state))
            low, width = self.windows(projected[active], radius)
            for q, lo, wide in zip(active.tolist(), low, width):
                found, score, done, verified = state[q]
                # places below the window wrap to large numbers
                count = ((self.place - lo[:, None]) < wide[:, None]).sum(axis=0, dtype=np.uint8 if PROJECTIONS < 256 else np.uint16)
                new = np.flatnonzero((count >= self.least) & ~done) if radius < 2 else np.flatnonzero(~done)
                if len(new):
                    done[new] = True
                    found, score = np.concatenate([found, new]), np.concatenate([score, self.unit[new] @ unit[q]])
                    best = np.lexsort((self.ids[found], -score))[:4 * k]
                    found, score, verified = found[best], score[best], verified + len(new)
                state[q] = found, score, done, verified
                if len(score) >= k and 2 - 2 * score[k - 1] <= radius ** 2 or radius >= 2:
                    out[q] = found, verified
                    del state[q]
            if not state:
                break
        return out


def _nearest(key, data: pa.Table, asked: pa.Table, k: int, size: int) -> pa.Table:
    names = ["query_id", "vec_id", "score", "verified"]
    empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=names)
    if not data.num_rows or not asked.num_rows:
        return empty
    flat = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, size)
    block = Block(data.column("vec_id").to_numpy(), flat(data))
    ids, vectors = asked.column("vec_id").to_numpy(), flat(asked)
    norms = np.linalg.norm(block.exact, axis=1)
    rows = []
    for own, query, (found, verified) in zip(ids.tolist(), vectors, block.search(ids, vectors, k)):
        score = block.exact[found] @ query / (norms[found] * np.linalg.norm(query))
        best = np.lexsort((block.ids[found], -score))[:k]
        rows += [(own, int(block.ids[found[b]]), float(score[b]), verified if n == 0 else 0) for n, b in enumerate(best)]
    if not rows:
        return empty
    cols = list(zip(*rows))
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64())], names=names)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v double[]) of the vectors that can take part: not null, not zero, all components finite, of the commonest length.

    A repeated id counts once, with its largest vector; a null id takes no part.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    return v.groupBy("vec_id").agg(F.max("v").alias("v"))


def nearest(vectors: DataFrame, k: int = 5, every: int = EVERY) -> DataFrame:
    """The k nearest other vectors, by cosine, of each vector whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score and n_verified (exact cosines
    computed for the query). Ties go to the smaller vec_id. Vectors that are null
    or zero, or hold null or non-finite components, take no part, nor do vectors
    of another length than most; fewer than k candidates are all returned. Other
    columns are ignored; an empty table gives no rows.

    Each vector is copied once per block of queries and each query once per block
    of vectors, so a task holds BLOCK vectors and QUERIES queries at any size. A
    task sends k rows for each of its queries.
    """
    all_vectors = cut_lineage(usable(vectors))
    sizes = all_vectors.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_verified long")
    size = int(sizes[0]["s"])
    data = all_vectors.where(F.size("v") == size)
    n = int(sizes[0]["count"])
    asked = data.where(F.col("vec_id") % every == 0)
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-asked.count() // QUERIES))
    part = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    rows = data.select(part(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "vec_id", "v")
    wants = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part(groups).alias("group"), "vec_id", "v")

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(key, left, right, k, size)

    found = (rows.groupBy("block", "group").cogroup(wants.groupBy("block", "group"))
             .applyInArrow(search, "query_id long, vec_id long, score double, verified long"))
    per_block = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"), F.sum("verified").alias("n_verified"))
    return (per_block.select("query_id", "n_verified", F.posexplode("best").alias("r", "b"))
            .select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"), "n_verified"))
