"""Similarity join of documents by their word 5-grams (Jaccard 0.8 or more), with Bayesian candidate pruning.

Equal texts are one text with a number of copies. Every text gets 128 MinHash
values; texts that agree in a whole band of four values are candidates. A pair's
values are compared sixteen at a time. After n values with m agreements the
posterior probability of similarity >= t under a uniform prior is that of at most
m successes in n + 1 draws of probability t; a pair is dropped once it falls
below ``TOLERANCE``. What is left after all values is verified exactly on the
shingle sets.

Pairs are never listed. The members of a band bucket are compared block by block
inside tasks, and of what survives only a spanning star per block leaves the
task; the components of these stars hold every surviving pair. Each component is
then compared once more in blocks, now with the shingle sets, and every text
leaves with its number of verified links and a star of its block. So a group of
many near copies costs comparisons, but rows only in proportion to its texts.
"""

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import components, cut_lineage

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values, compared STEP at a time; the first BANDS * ROWS of them make the bands. A pair at 0.8 shares no band once in 300,000.
VALUES, STEP, BANDS, ROWS = 128, 16, 24, 4
TOLERANCE = 1e-4
#: Members of a block, and shingles of a block where sets are needed.
BLOCK, BLOCK_SHINGLES = 512, 400_000
MAP_BITS = 1 << 22
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MIX = np.random.default_rng(17).integers(1, 2 ** 63, (2, VALUES), dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words, even none, are one shingle."""
    words = _WORDS((text or "").translate(_LOWER))
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), seed=1)], np.uint64)
    n = len(h) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s = (s ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    out = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        part = s[k:k + 4096]
        h = part[:, None] * _MIX[0] + _MIX[1]
        h ^= h >> np.uint64(32)
        np.minimum(out, (h * np.uint64(0xD6E8FEB86659FD93)).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_agreements(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest agreements among n values with which a pair's posterior of reaching the threshold is still the tolerance."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of two signature blocks are left by the incremental comparison, as a matrix."""
    agree = np.zeros((len(a), len(b)), np.int16)
    alive = np.ones((len(a), len(b)), bool)
    for n in range(STEP, VALUES + 1, STEP):
        least = least_agreements(n)
        if alive.mean() > 0.05:
            for k in range(n - STEP, n):
                agree += a[:, k, None] == b[None, :, k]
            alive &= agree >= least
        else:  # few are left: only these
            i, j = np.nonzero(alive)
            agree[i, j] += (a[i, n - STEP:n] == b[j, n - STEP:n]).sum(axis=1).astype(np.int16)
            alive[i, j] = agree[i, j] >= least
    return alive


def _stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes with a link in a block pair."""
    i, j = np.nonzero(linked)
    names, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    u, v = at[i], at[len(left) + j]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    seen = np.unique(np.concatenate([u, v])) if len(u) else np.empty(0, int)
    return names[seen], names[root[seen]]


def _blocks(members: DataFrame, key: str, count: str) -> DataFrame:
    """Deal the members of a group into ``count`` blocks and copy each to the block pairs (i, j), i <= j, that it is part of."""
    b = F.pmod(F.xxhash64("tid"), F.col(count)).cast("int")
    return (members.withColumn("_b", b).withColumn("_o", F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int"))))
            .withColumn("i", F.least("_b", "_o")).withColumn("j", F.greatest("_b", "_o")).drop("_o"))


def _matrix(column: pd.Series, kind) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in column])


def _candidate_stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning stars of the pairs of one block pair of a bucket that pruning leaves."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    left, right = pdf[pdf["_b"] == i], pdf[pdf["_b"] == j]
    if not len(left) or not len(right):
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    alive = survivors(_matrix(left["sig"], np.int32), _matrix(right["sig"], np.int32))
    u, v = _stars(alive, left["tid"].to_numpy(), right["tid"].to_numpy())
    return pd.DataFrame({"u": u, "v": v})[u != v]


def _verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of the texts of one block pair of a component: (tid, links, root), with copies counted."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    left, right = pdf[pdf["_b"] == i].reset_index(drop=True), pdf[pdf["_b"] == j].reset_index(drop=True)
    empty = pd.DataFrame({"tid": [], "links": [], "root": []}, dtype="int64")
    if not len(left) or not len(right):
        return empty
    alive = survivors(_matrix(left["sig"], np.int32), _matrix(right["sig"], np.int32))
    if i == j:
        alive = np.triu(alive, 1)
    r, c = np.nonzero(alive)
    if not len(r):
        return empty
    sets_a, sets_b = [[np.frombuffer(x, np.uint64) for x in side["shingles"]] for side in (left, right)]
    size_a, size_b = np.array(list(map(len, sets_a))), np.array(list(map(len, sets_b)))
    # an intersection of so few is below the threshold for these sizes
    common = _intersections(sets_a, sets_b, r, c)
    real = common >= THRESHOLD * (size_a[r] + size_b[c] - common) - 1e-9
    r, c = r[real], c[real]
    linked = np.zeros((len(left), len(right)), bool)
    linked[r, c] = True
    u, root = _stars(linked, left["tid"].to_numpy(), right["tid"].to_numpy())
    ta, tb = left["tid"].to_numpy(), right["tid"].to_numpy()
    count = pd.concat([pd.DataFrame({"tid": ta[r], "links": right["copies"].to_numpy()[c]}),
                       pd.DataFrame({"tid": tb[c], "links": left["copies"].to_numpy()[r]})]).groupby("tid", as_index=False)["links"].sum()
    return count.merge(pd.DataFrame({"tid": u, "root": root}), on="tid")[["tid", "links", "root"]]


def _intersections(a: list[np.ndarray], b: list[np.ndarray], r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a[r], b[c]): products of 0/1 matrices over shingles that several texts have."""
    if len(r) < 16:
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(r, c)])
    values, where = np.unique(np.concatenate(a + b), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    several = np.bincount(where, minlength=len(values)) > 1
    number = np.cumsum(several) - 1
    keep = several[where]
    row, col = row[keep], number[where[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for k in range(0, int(several.sum()), 4096):
        lo, hi = np.searchsorted(col, [k, k + 4096])
        m = np.zeros((len(a) + len(b), 4096), np.float32)
        m[row[lo:hi], col[lo:hi] - k] = 1
        out += m[:len(a)] @ m[len(a):].T
    return out[r, c].astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    """Distinct texts: tid, h (md5), copies, n (shingles), sig."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([signature(s).tobytes() for s in sets], pa.binary())],
                                             names=["h", "n", "sig"])

    signs = docs.select("h", "text").mapInArrow(signed, "h string, n long, sig binary")
    one = signs.groupBy("h").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    return cut_lineage(one.select(F.monotonically_increasing_id().alias("tid"), "h", "copies", "n", "sig"))


def _buckets(texts: DataFrame) -> DataFrame:
    """Members (key, tid, size) of the band buckets with several texts; of buckets with the same members only one is kept."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.stack([np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]).astype(np.uint64)[:, :BANDS * ROWS].reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), sig.shape[:2]).copy()
                for k in range(ROWS):
                    key = (key ^ sig[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(key.reshape(-1).view(np.int64))], names=["tid", "key"])

    rows = texts.select("tid", "sig").mapInArrow(bands, "tid long, key long")
    content = rows.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(1))).alias("y")).where("size > 1")
    kept = content.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    return rows.join(kept, "key")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, shingles) of the texts in ``wanted``: the texts are read once more, past a bit map of fixed size."""
    bits = wanted.select(F.pmod(F.xxhash64("h"), F.lit(MAP_BITS)).alias("b")).groupBy(F.floor(F.col("b") / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("v")).collect()  # at most MAP_BITS / 64 rows
    table = np.zeros(MAP_BITS // 64, np.int64)
    for r in bits:
        table[r["at"]] = r["v"]
    held = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(2).to_numpy().astype(np.uint64)
            hit = (held.value[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) == 1
            part = batch.filter(pa.array(hit))
            for k in range(0, part.num_rows, 500):
                some = part.slice(k, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingles(t).tobytes() for t in some.column(1).to_pylist()], pa.binary())], names=["h", "shingles"])

    found = docs.select("h", "text", F.pmod(F.xxhash64("h"), F.lit(MAP_BITS)).alias("b")).mapInArrow(made, "h string, shingles binary")
    return found.groupBy("h").agg(F.first("shingles").alias("shingles"))


def text_classes(docs: DataFrame) -> DataFrame:
    """Distinct texts of ``docs`` (doc_id, text): h (md5 of the text), tid, copies, links (documents linked to one copy), class (a tid)."""
    plain = docs.select(F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = _texts(plain)
    members = _buckets(texts).withColumn("_n", F.ceil(F.col("size") / BLOCK).cast("long"))
    dealt = _blocks(members, "key", "_n").join(texts.select("tid", "sig"), "tid").select("key", "i", "j", "_b", "tid", "sig")
    stars = cut_lineage(dealt.groupBy("key", "i", "j").applyInPandas(_candidate_stars, "u long, v long").distinct())
    groups = cut_lineage(components(stars).join(texts.withColumnRenamed("tid", "node"), "node").select(F.col("node").alias("tid"), "root", "h", "n", "copies", "sig"))
    size = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("_n"))
    full = groups.join(_sets(plain, groups), "h").join(size, "root")
    pairs = _blocks(full, "root", "_n").select("root", "i", "j", "_b", "tid", "copies", "sig", "shingles")
    found = cut_lineage(pairs.groupBy("root", "i", "j").applyInPandas(_verified, "tid long, links long, root long"))
    links = found.groupBy("tid").agg(F.sum("links").alias("_links"))
    classes = components(found.select(F.col("tid").alias("u"), F.col("root").alias("v")))
    out = texts.select("tid", "h", "copies").join(links, "tid", "left").join(classes.withColumnRenamed("node", "tid"), "tid", "left")
    return cut_lineage(out.select("h", "tid", "copies", (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("links"), F.coalesce("root", "tid").alias("class")))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, n_links and class_size.

    ``n_links`` counts the other documents whose similarity is 0.8 or more
    (copies included), ``class_id`` is the smallest doc_id that links connect the
    document with. Null and empty texts, and texts without words, count as equal
    to each other; texts of fewer than five words are one shingle. Repeated rows
    are documents of their own; a null doc_id is no class_id unless the class has
    no other. Other columns are ignored; an empty table gives no rows.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("h"))
    classes = text_classes(docs)
    known = cut_lineage(ids.join(classes, "h").select("doc_id", "links", "class"))
    names = known.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return known.join(names, "class").select("doc_id", "class_id", F.col("links").alias("n_links"), "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without the near duplicates: of each class the row with the smallest doc_id stays, with all its columns.

    Ties (repeated ids) go to the smaller text digest, repeated rows to any one
    of them. A null doc_id comes after all others.
    """
    h = F.md5(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))
    ids = docs.select(F.col("doc_id").cast("long").alias("_i"), h.alias("h"))
    per_text = ids.groupBy("h").agg(F.min("_i").alias("_i"))
    best = (per_text.join(text_classes(docs), "h").groupBy("class")
            .agg(F.min(F.struct(F.col("_i").isNull().alias("last"), F.col("_i"), F.col("h"))).alias("m")).select(F.col("m._i").alias("_i"), F.col("m.h").alias("_h")))
    named = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_id"), h.alias("_k"))
    met = named.join(best, (F.col("_k") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i")))
    return met.dropDuplicates(["_k"]).select("_doc.*")
