"""Language-model scoring with a probabilistic suffix tree over bytes.

Symbols are the bytes of the text with A-Z lower-cased, then one end. A context
of up to ``DEPTH`` bytes is a candidate if its share of all training positions is
at least ``LEAST_SHARE``, which bounds the tree by ``DEPTH / LEAST_SHARE`` contexts
whatever the corpus. A candidate is retained if what its own next-symbol
distribution gains in log-likelihood over its parent's (the context without its
first byte) exceeds half its number of next symbols times the log of the
training size; with a context its suffixes are retained too. A symbol's
probability comes from the longest retained suffix of what stands before it,
each distribution being smoothed towards its parent's.

Beside the tree stands the unigram score of the words, with exact counts of all
training tokens. The most frequent words go to the tasks as a table of bounded
size; the occurrences of all others meet their counts in a join, by word.
"""

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import cut_lineage, stored

DEPTH, LEAST_SHARE, SMOOTHING = 6, 1e-5, 4.0
START, END = 254, 255  # no bytes of UTF-8
#: Most frequent words whose counts every task gets.
HEAD = 100_000
#: Distinct words, and positions, that a task adds up before it sends counts on.
FLUSH_WORDS, FLUSH_CODES = 400_000, 4_000_000
#: Contexts of a tree that is scored by tables, of at most three kilobytes a context.
TABLE_CONTEXTS = 60_000
HELD = 10


def held_out(doc_id: int | None) -> bool:
    """Rows that nothing is learned from: crc32 of the id as text divisible by 10 (a null id counts as an empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD == 0


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as one row of bytes, DEPTH starts before each and an end after it, and where each begins among the positions to score."""
    start, end = bytes([START]) * DEPTH, bytes([END])
    x = np.frombuffer(b"".join(start + t + end for t in texts), np.uint8)
    counts = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return x, np.r_[0, np.cumsum(counts)[:-1]]


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every position of lower-cased texts, DEPTH + 1 bytes in a number, and where each text begins."""
    x, begin = symbols(texts)
    n = len(x) - DEPTH
    code = np.zeros(n, np.int64)
    for k in range(DEPTH + 1):
        code <<= 8
        code |= x[k:k + n]
    return code[x[DEPTH:] != START], begin


def _counted(docs: DataFrame) -> DataFrame:
    """Partial counts (word, code, n) of the training rows, each task's summed up in batches."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pending, waiting = [], 0

        def out(w, c, n):
            return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "code", "n"])

        def summed(parts):
            value, inverse = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            return value, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [(t or "").encode().lower() for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if not held_out(d)]
                for t in texts:
                    words.update(t.split())
                words[b""] += len(texts)  # their ends
                if texts:
                    value, n = np.unique(codes(texts)[0], return_counts=True)
                    pending.append((value, n))
                    waiting += len(value)
                if waiting > FLUSH_CODES:
                    pending = [summed(pending)]
                    waiting = len(pending[0][0])
                    if waiting > FLUSH_CODES // 2:
                        yield out([None] * waiting, *pending[0])
                        pending, waiting = [], 0
                if len(words) > FLUSH_WORDS:
                    yield out(list(words), [None] * len(words), list(words.values()))
                    words = Counter()
        if words:
            yield out(list(words), [None] * len(words), list(words.values()))
        if pending:
            value, n = summed(pending)
            yield out([None] * len(value), value, n)

    return docs.mapInArrow(count, "word binary, code long, n long")


@dataclass
class Tree:
    """Retained contexts by length: sorted codes, their totals, and sorted (context, symbol) codes with counts."""
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    events: list[np.ndarray]
    counts: list[np.ndarray]

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each position's symbol after its longest retained context."""
        symbol = code & 255
        p = np.full(len(code), 1 / 256)
        live = np.arange(len(code))
        for length in range(DEPTH + 1):
            if not len(self.contexts[length]):
                break
            event = code[live] & ((1 << 8 * (length + 1)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[length], event >> 8), len(self.contexts[length]) - 1)
            known = self.contexts[length][at] == event >> 8
            live, event, at = live[known], event[known], at[known]
            e = np.minimum(np.searchsorted(self.events[length], event), len(self.events[length]) - 1)
            n = np.where(self.events[length][e] == event, self.counts[length][e], 0)
            p[live] = (n + SMOOTHING * p[live]) / (self.totals[length][at] + SMOOTHING)
        return np.log10(p)


def retain(rows: list[tuple[np.ndarray, np.ndarray]]) -> Tree:
    """The tree of candidate counts: for each length, sorted (context, symbol) codes and their counts."""
    size = int(rows[0][1].sum()) if len(rows[0][1]) else 0
    total, context, keep = [], [], []
    for length, (event, n) in enumerate(rows):
        ctx, first = np.unique(event >> 8, return_index=True)
        total.append(np.add.reduceat(n, first) if len(first) else np.empty(0, np.int64))
        context.append(ctx)
        if length == 0:
            keep.append(np.ones(len(ctx), bool))
            continue
        own = np.searchsorted(ctx, event >> 8)
        below = (1 << 8 * length) - 1  # the same event without the context's first byte
        up = rows[length - 1]
        e = np.searchsorted(up[0], event & below)
        t = np.searchsorted(context[length - 1], (event & below) >> 8)
        gain = np.bincount(own, n * np.log(n / total[length][own] * total[length - 1][t] / up[1][e]), len(ctx))
        kinds = np.bincount(own, minlength=len(ctx))
        keep.append(gain > 0.5 * kinds * np.log(max(size, 2)))
    for length in range(DEPTH, 1, -1):  # suffixes of what is retained
        short = context[length][keep[length]] & ((1 << 8 * (length - 1)) - 1)
        keep[length - 1][np.searchsorted(context[length - 1], short)] = True
    held = [np.isin(event >> 8, context[k][keep[k]]) for k, (event, _) in enumerate(rows)]
    return Tree([c[k] for c, k in zip(context, keep)], [t[k] for t, k in zip(total, keep)],
                [e[h] for (e, _), h in zip(rows, held)], [n[h] for (_, n), h in zip(rows, held)])


def grow(grams: DataFrame) -> Tree:
    """Tree from the counts (code, n) of all positions. The driver gets candidate contexts only, DEPTH / LEAST_SHARE at most."""
    each = grams.select(F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("length"), "code", "n")
    masks = F.element_at(F.array(*[F.lit((1 << 8 * (k + 1)) - 1) for k in range(DEPTH + 1)]), F.col("length") + 1)
    events = cut_lineage(each.groupBy("length", F.col("code").bitwiseAND(masks).alias("event")).agg(F.sum("n").alias("n")))
    size = events.where("length = 0").agg(F.sum("n")).first()[0] or 0
    context = F.shiftright("event", 8)
    often = events.groupBy("length", context.alias("context")).agg(F.sum("n").alias("total")).where(F.col("total") >= LEAST_SHARE * size)
    kept = (events.withColumn("context", context).join(often, ["length", "context"]).select("length", "event", "n")
            .orderBy("length", "event").toArrow())
    length, event, n = (np.asarray(kept.column(k).to_numpy(), np.int64) for k in range(3))
    return retain([(event[length == k], n[length == k]) for k in range(DEPTH + 1)])


class _Table:
    """The tree as tables over (context, byte): a position walks from context to longer context and looks its probability up.

    The values are those of ``Tree.log10``, made once for each context in the same order of steps.
    """

    def __init__(self, tree: Tree):
        self.kind = np.zeros(256, np.intp)  # bytes that the tree has as symbols; all others are the last kind
        used = np.unique(np.concatenate([e & 255 for e in tree.events] + [c >> 8 * (k - 1) & 255 for k, c in enumerate(tree.contexts) if k]))
        width = self.width = len(used) + 1
        self.kind[:] = width - 1
        self.kind[used] = np.arange(len(used))
        size = [len(c) for c in tree.contexts]
        first = np.cumsum([0, *size])
        self.child = np.full(int(first[-1]) * width, -1, np.int32)  # where the longer context's row begins
        p = np.empty((int(first[-1]), width))
        for length, context in enumerate(tree.contexts):
            own = np.arange(first[length], first[length + 1])
            if not len(context):
                break
            if length:
                up = first[length - 1] + np.searchsorted(tree.contexts[length - 1], context & ((1 << 8 * (length - 1)) - 1))
                self.child[up * width + self.kind[context >> 8 * (length - 1)]] = own * width
                before = p[up]
            else:
                before = np.full((1, width), 1 / 256)
            n = np.zeros((len(context), width))
            event = tree.events[length]
            n[np.searchsorted(context, event >> 8), self.kind[event & 255]] = tree.counts[length]
            p[own] = (n + SMOOTHING * before) / (tree.totals[length][:, None] + SMOOTHING)
        self.value = np.log10(p).ravel()

    @staticmethod
    def fits(tree: Tree) -> bool:
        return 0 < len(tree.contexts[0]) and sum(map(len, tree.contexts)) <= TABLE_CONTEXTS

    def __call__(self, code: np.ndarray) -> np.ndarray:
        return self._walked(len(code), lambda live, length: self.kind[code[live] >> 8 * length & 255])

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every position of lower-cased texts, and where each text begins."""
        x, begin = symbols(texts)
        kind, at = self.kind[x], np.flatnonzero(x != START)
        return self._walked(len(at), lambda live, length: kind[at[live] - length]), begin

    def _walked(self, n: int, kind: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
        """Log probability of n positions; ``kind`` gives the kind of byte so far before some of them."""
        row = np.zeros(n, np.intp)  # where the context's row begins
        live, deep = np.arange(n), row
        for length in range(1, DEPTH + 1):
            deep = self.child[deep + kind(live, length)]
            known = np.flatnonzero(deep >= 0)
            if not len(known):
                break
            live, deep = live[known], deep[known]
            row[live] = deep
        return self.value[row + kind(slice(None), 0)]


def scores_of(tree: Tree) -> "_Table | _Scores":
    """Log probabilities by tables, or by search where a tree is too large for them."""
    if "made" not in tree.__dict__:  # once a worker
        tree.made = _Table(tree) if _Table.fits(tree) else _Scores(tree)
    return tree.made


class _Scores:
    """Log probabilities of positions, remembered in a table of fixed size."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.key = np.full(1 << 20, -1, np.int64)
        self.value = np.zeros(1 << 20)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        slot = code * 2654435761 >> 20 & 0xFFFFF
        out = self.value[slot]
        new = self.key[slot] != code
        if new.any():
            unknown, where = np.unique(code[new], return_inverse=True)
            out[new] = self.tree.log10(unknown)[where]
            self.key[slot[new]] = code[new]
            self.value[slot[new]] = out[new]
        return out

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        code, begin = codes(texts)
        return self(code), begin


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of every text by a model of the rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (the
    unigram score) and score (log10 probability of the text by the suffix tree).
    A null or empty text is its end alone. A null doc_id is held out. Repeated
    rows all train and are all scored; other columns are ignored; an empty table
    gives no rows, and without training rows the tree is uniform and no token is
    known.

    No text is shuffled: words and byte contexts are counted in the tasks that
    read them, and a document sends only its rarer words, to be joined with their
    counts.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = stored(_counted(plain))
    words = cut_lineage(raw.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")))
    tree = grow(raw.where("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n")))
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train, below = int(size["n"]), float(np.log10(size["n"] + 0.1 * (size["v"] + 1)))
    # the least count that at most HEAD words have
    many, least = 0, 1
    spread = words.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).count().orderBy(F.desc("c")).collect()
    for r in spread:
        many += r["count"]
        if many > HEAD:
            least = r["c"] + 1
            break
    head = words.where(F.col("c") >= least).toArrow()  # HEAD rows at most
    known = dict(zip(head.column("word").to_pylist(), (np.log10(head.column("c").to_numpy() + 0.1) - below).tolist()))
    held = docs.sparkSession.sparkContext.broadcast((tree, known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known = held.value
        of = scores_of(tree)
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                part = batch.slice(k, 100)
                texts = [(t or "").encode().lower() for t in part.column(1).to_pylist()]
                value, starts = of.of_texts(texts)
                model = np.add.reduceat(value, starts)
                total, sums, hits, rare, many, ends = [], [], [], [], [], [0]
                for t in texts:
                    tokens = t.split()
                    tokens.append(b"")
                    value = list(map(known.get, tokens))
                    missed = [w for w, v in zip(tokens, value) if v is None]
                    total.append(len(tokens))
                    hits.append(len(tokens) - len(missed))
                    sums.append(sum(filter(None, value)))  # no word has the value 0
                    few = Counter(missed)
                    rare += few
                    many += few.values()
                    ends.append(len(rare))
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([held_out(d) for d in ids]), pa.array(total, pa.int64()), pa.array(hits, pa.int64()), pa.array(sums, pa.float64()),
                     pa.array(model, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(many, pa.int32())], ["word", "n"]))],
                    names=["doc_id", "held_out", "n_tokens", "hits", "sums", "score", "rare"])

    shape = "doc_id long, held_out boolean, n_tokens long, hits long, sums double, score double, rare array<struct<word: binary, n: int>>"
    table = stored(plain.mapInArrow(score, shape).withColumn("_row", F.monotonically_increasing_id()))
    rare = table.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.n")
    met = rare.join(words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    per_row = met.groupBy("_row").agg(F.sum(F.col("n") * (F.log10(F.col("c") + 0.1) - F.lit(below))).alias("_more"),
                                      F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"))
    return table.join(per_row, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("_more", F.lit(0.0))).alias("base_score"), "score")
