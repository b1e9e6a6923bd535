"""Runs of periodically repeated words, found on a grammar of the text.

The words of a batch of documents become numbers, and Re-Pair compresses their
sequence: the commonest neighbouring pair gets a symbol of its own wherever it
stands, until no pair is left twice. A round replaces all pairs that are commoner
than both their neighbours at once, which is what replacing one after another
does to pairs that do not touch. Documents are parted by marks that no pair
takes in; a passage that many documents share is one symbol.

A run that is not inside one child of a symbol crosses the place where its two
children meet. Such runs are computed once for each symbol and moved to all
places that the symbol derives to; what the compressed documents themselves add
is found at the meeting places of a balanced tree over their symbols. A run that
a symbol's border cuts off appears in full further up, and intervals of one
period that overlap by a period or more are merged into the longest.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words of the documents that share a grammar; a longer document has one of its own.
BATCH_WORDS = 200_000
#: (place, period) pairs that are compared at once.
AT_ONCE = 1 << 20

_WORDS = re.compile("[^\x20\x09-\x0d]+").findall


class Grammar(NamedTuple):
    """Symbols ``base + k`` with children, size and one place each, the rounds they came from, and the compressed sequence."""
    base: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    at: np.ndarray
    rounds: list[tuple[int, int]]
    top: np.ndarray
    place: np.ndarray


def _mixed(key: np.ndarray) -> np.ndarray:
    """Some fixed order among keys of one count, so that long repeats do not become one-sided trees."""
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def re_pair(text: np.ndarray, base: int, marks: int) -> Grammar:
    """Re-Pair of ``text`` (numbers below ``base``; the largest ``marks`` of them part documents)."""
    sym, place = text.astype(np.int64), np.arange(len(text), dtype=np.int64)
    is_mark = (sym >= base - marks) & (sym < base)
    active = ~(is_mark[:-1] | is_mark[1:])
    left, right, at, rounds, made = [], [], [], [], 0
    while True:
        idx = np.flatnonzero(active)
        key = (sym[idx] << 31) | sym[idx + 1]
        if len(idx) > 1:
            # a pair of equal symbols overlaps itself: only every second place of such a stretch counts
            joined = np.concatenate(([False], (np.diff(idx) == 1) & (key[1:] == key[:-1])))
            if joined.any():
                begins = np.flatnonzero(~joined)
                within = np.arange(len(idx)) - np.repeat(begins, np.diff(np.append(begins, len(idx))))
                idx, key = idx[within % 2 == 0], key[within % 2 == 0]
        found, which, count = np.unique(key, return_inverse=True, return_counts=True)
        active[idx] = count[which] > 1
        if not (count > 1).any():
            break
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((_mixed(found), count))] = np.arange(1, len(found) + 1)
        rank[count < 2] = 0
        mine = rank[which]
        beside = np.zeros(len(sym) + 1, np.int64)
        beside[idx + 1] = mine
        taken = (mine > beside[idx]) & (mine > beside[idx + 2])
        idx, which = idx[taken], which[taken]
        used, which, count = np.unique(which, return_inverse=True, return_counts=True)
        new = np.cumsum(count > 1) - 1
        idx, which = idx[count[which] > 1], new[which[count[which] > 1]]
        used = used[count > 1]
        first = np.empty(len(used), np.int64)
        first[which[::-1]] = place[idx[::-1]]
        left.append(found[used] >> 31)
        right.append(found[used] & ((1 << 31) - 1))
        at.append(first)
        rounds.append((made, made + len(used)))
        sym[idx] = base + made + which
        made += len(used)
        changed, keep = np.zeros(len(sym), bool), np.ones(len(sym), bool)
        changed[idx], keep[idx + 1] = True, False
        old = np.flatnonzero(keep)
        sym, place, changed = sym[old], place[old], changed[old]
        is_mark = (sym >= base - marks) & (sym < base)
        active = (changed[:-1] | changed[1:] | active[old[:-1]]) & ~(is_mark[:-1] | is_mark[1:])
    size = np.ones(made, np.int64)
    lefts, rights = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    for a, b in rounds:
        for child in (lefts[a:b], rights[a:b]):
            inner = child >= base
            size[a:b] += np.where(inner, size[np.where(inner, child - base, 0)], 1)
        size[a:b] -= 1
    return Grammar(base, lefts, rights, size, np.concatenate(at) if at else np.zeros(0, np.int64), rounds, sym, place)


def _matches_ahead(text: np.ndarray, a: int, q: int, end: int) -> int:
    """First place from ``a`` on, at most ``end``, where the word ``q`` further on differs."""
    step = 16
    while a < end:
        n = min(step, end - a)
        off = text[a:a + n] != text[a + q:a + q + n]
        k = int(off.argmax())
        if off[k]:
            return a + k
        a, step = a + n, step * 4
    return end


def _matches_behind(text: np.ndarray, a: int, q: int, begin: int) -> int:
    """Smallest place down to which, from ``a`` - 1 on backwards, all words equal the ones ``q`` further on."""
    step = 16
    while a > begin:
        n = min(step, a - begin)
        off = (text[a - n:a] != text[a - n + q:a + q])[::-1]
        k = int(off.argmax())
        if off[k]:
            return a - k
        a, step = a - n, step * 4
    return begin


def crossing_runs(text: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(node, begin, end, period) of the runs inside text[lo:hi] that cross ``mid``, for all nodes.

    Words that equal the word one period on form a stretch of at least three
    periods; it takes in the place before ``mid`` or the one a period before
    that. Both are compared for every period up to a quarter of the node, then
    the neighbours, and what is left is followed to its ends.
    """
    longest = (hi - lo) // LEAST_PERIODS
    longest[hi - lo < LEAST_WORDS] = 0
    nodes = np.flatnonzero(longest)
    upto = np.cumsum(longest[nodes])
    out: list[tuple[int, int, int, int]] = []
    begin = 0
    while begin < len(nodes):
        stop = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + AT_ONCE, "right")))
        some = nodes[begin:stop]
        begin = stop
        many = longest[some]
        node = np.repeat(some, many)
        q = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(many) - many, many)
        left = []
        for a in (mid[node] - 1, mid[node] - 1 - q):
            ok = np.flatnonzero((a >= lo[node]) & (a + q < hi[node]))
            ok = ok[text[a[ok]] == text[a[ok] + q[ok]]]
            n, p, x = node[ok], q[ok], a[ok]

            def same(k: int) -> np.ndarray:
                y = x + k
                inside = (y >= lo[n]) & (y + p < hi[n])
                y = np.where(inside, y, x)
                return inside & (text[y] == text[y + p])

            behind, ahead, back, fore = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), True, True
            for k in range(1, 9):
                back, fore = back & same(-k), fore & same(k)
                behind += back
                ahead += fore
                if k in (2, 4):
                    go = np.flatnonzero((behind == k) | (ahead == k) | (behind + ahead + 1 + p >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)))
                    n, p, x, behind, ahead, back, fore = (v[go] for v in (n, p, x, behind, ahead, back, fore))
            good = (behind == 8) | (ahead == 8) | (behind + ahead + 1 + p >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p))
            left.append(np.stack([n[good], p[good], x[good]], axis=1))
        todo = np.concatenate(left)
        todo = todo[np.lexsort((todo[:, 1], todo[:, 0]))]
        found: list[tuple[int, int, int]] = []
        at = -1
        for n, p, x in todo.tolist():
            if n != at:
                found, at = [], n
            # from a place inside a run, a multiple of its period leads to the same two ends
            if any(p % r == 0 and s <= x < e - p for s, e, r in found):
                continue
            s, e = _matches_behind(text, x, p, int(lo[n])), _matches_ahead(text, x + 1, p, int(hi[n]) - p) + p
            if e - s >= max(LEAST_WORDS, LEAST_PERIODS * p) and e > mid[n]:
                found.append((s, e, p))
                out.append((n, s, e, p))
    return out


def _tree(grammar: Grammar, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, mid, hi) of the inner nodes of a balanced tree over each document's symbols; ``marks`` are its closing marks' places in ``top``."""
    first = np.concatenate(([0], marks[:-1] + 1))
    count, half, parts = marks - first, 1, []
    while (count > half).any():
        docs = np.flatnonzero(count > half)
        nodes = -(-(count[docs] - half) // (2 * half))
        doc = np.repeat(docs, nodes)
        j = np.arange(len(doc)) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        lo = first[doc] + 2 * half * j
        parts.append(np.stack([grammar.place[lo], grammar.place[lo + half], grammar.place[np.minimum(lo + 2 * half, marks[doc])]]))
        half *= 2
    lo, mid, hi = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
    return lo, mid, hi


def _derived(grammar: Grammar, runs: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Rows (begin, end, period) of the symbols' runs at every place of the text that a symbol derives to."""
    if not runs:
        return np.zeros((0, 3), np.int64)
    table = np.array(sorted(runs), np.int64)
    table[:, 1:3] -= grammar.at[table[:, 0]][:, None]
    base, made = grammar.base, len(grammar.left)
    has = np.zeros(made, bool)
    has[table[:, 0]] = True

    def holds(child: np.ndarray) -> np.ndarray:
        inner = child >= base
        return inner & has[np.where(inner, child - base, 0)]

    for a, b in grammar.rounds:
        has[a:b] |= holds(grammar.left[a:b]) | holds(grammar.right[a:b])
    start, stop = np.searchsorted(table[:, 0], np.arange(made)), np.searchsorted(table[:, 0], np.arange(made), "right")
    here = holds(grammar.top)
    symbol, place, out = grammar.top[here] - base, grammar.place[here], []
    while len(symbol):
        many = stop[symbol] - start[symbol]
        row = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[symbol], many)
        moved = table[row, 1:].copy()
        moved[:, :2] += np.repeat(place, many)[:, None]
        out.append(moved)
        l, r = grammar.left[symbol], grammar.right[symbol]
        second = place + np.where(l >= base, grammar.size[np.where(l >= base, l - base, 0)], 1)
        go, too = holds(l), holds(r)
        symbol, place = np.concatenate((l[go], r[too])) - base, np.concatenate((place[go], second[too]))
    return np.concatenate(out)


def merged(runs: np.ndarray) -> np.ndarray:
    """Rows (begin, end, period) with intervals of one period that overlap by a period or more joined; by begin, then period."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    begin, end, q = runs.T
    group = np.cumsum(np.concatenate(([0], q[1:] != q[:-1])))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide  # furthest end so far within the period
    fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (begin[1:] > reach[:-1] - q[1:])))
    last = np.concatenate((np.flatnonzero(fresh)[1:] - 1, [len(runs) - 1]))
    out = np.stack([begin[fresh], reach[last], q[fresh]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each sequence of word numbers its runs as rows (start, length, period), by start, then period."""
    words = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    whole = np.empty(int(ends[-1]) + 1 if len(ends) else 0, np.int64)
    whole[ends] = words + np.arange(len(texts))
    for t, e in zip(texts, ends):
        whole[e - len(t):e] = t
    grammar = re_pair(whole, words + len(texts), len(texts))
    half = grammar.at + np.where(grammar.left >= grammar.base, grammar.size[np.where(grammar.left >= grammar.base, grammar.left - grammar.base, 0)], 1) \
        if len(grammar.left) else grammar.at
    inside = crossing_runs(whole, grammar.at, half, grammar.at + grammar.size)
    marks = np.flatnonzero((grammar.top >= words) & (grammar.top < grammar.base))
    between = crossing_runs(whole, *_tree(grammar, marks))
    found = merged(np.concatenate((_derived(grammar, inside), np.array([r[1:] for r in between], np.int64).reshape(-1, 3))))
    doc = np.searchsorted(ends, found[:, 0])
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k, e in enumerate(ends):
        part = found[at[k]:at[k + 1]]
        out.append(np.stack([part[:, 0] - (e - len(texts[k])), part[:, 1] - part[:, 0], part[:, 2]], axis=1))
    return out


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document that the test plants a repetition in; None for others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay if of every run only the first period does."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] == 0


def document_runs(docs: list[tuple[int | None, str | None]], planted: bool = False) -> Iterator[tuple[int | None, list[str], np.ndarray]]:
    """(doc_id, words, runs) of each document, in order; grammars are shared by neighbours of BATCH_WORDS words."""
    batch: list[tuple[int | None, list[str]]] = []
    size = 0

    def results() -> Iterator[tuple[int | None, list[str], np.ndarray]]:
        number = pd.factorize(np.array([w for _, ws in batch for w in ws], object))[0]
        cuts = np.cumsum([len(ws) for _, ws in batch])
        for (doc_id, ws), runs in zip(batch, runs_of(np.split(number, cuts[:-1]))):
            yield doc_id, ws, runs

    for doc_id, text in docs:
        words = _WORDS(text or "")
        order = planted_order(doc_id, len(words)) if planted else None
        if order is not None:
            words = [words[k] for k in order.tolist()]
        if batch and size + len(words) > BATCH_WORDS:
            yield from results()
            batch, size = [], 0
        batch.append((doc_id, words))
        size += len(words)
    if batch:
        yield from results()


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The (start, length, period) with the most periods, then the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[list[tuple[int | None, str | None]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def find_runs(docs: DataFrame) -> DataFrame:
    """Every run of every document: doc_id, start (word number), length, period, words (of one period)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            out = [(doc_id, s, n, q, " ".join(words[s:s + q])) for doc_id, words, runs in document_runs(some) for s, n, q in runs.tolist()]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()])],
                                             names=["doc_id", "start", "length", "period", "words"])

    return _plain(docs).mapInArrow(rows, "doc_id long, start long, length long, period long, words string")


def periodic_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """One row per document: its number of runs, its strongest run, and digests of all runs and of the collapsed text.

    A run is a longest stretch of words with smallest period q and at least
    max(6, 4 q) words. Returns doc_id, n_runs, start, length, period and
    exponent_milli of the run with the most periods (null without runs),
    runs_sha256 and collapsed_sha256. ``planted`` repeats part of the words of
    every tenth document first, as the contract of the query says.

    A null, empty or blank text has no words and no runs. Repeated rows are
    documents like others; a null doc_id is never planted in; other columns are
    ignored; an empty table gives no rows. Texts of any length are read whole.

    Nothing is shuffled: a document is seen by one task, in grammars of
    ``BATCH_WORDS`` words; memory grows with a batch or the longest document.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            out = []
            for doc_id, words, runs in document_runs(some, planted):
                listed = [tuple(r) for r in runs.tolist()]
                best = strongest(listed)
                kept = [w for w, stays in zip(words, collapsed(len(words), runs).tolist()) if stays] if listed else words
                out.append((doc_id, len(listed), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest(),
                            hashlib.sha256(" ".join(kept).encode()).hexdigest()))
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.string()] * 2)],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return _plain(docs).mapInArrow(rows, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                         "runs_sha256 string, collapsed_sha256 string")
