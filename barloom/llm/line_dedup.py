"""Line dedup: exact repeats of any line, and near lines within an edit threshold that grows with their length.

A line of ``WORDS`` words or more is a sequence of words, any other a sequence of
characters. Two lines of one kind are near if at most ``allowed`` insertions,
deletions or replacements of an element part them: one word in twenty, at least
one and at most ``MOST``; one character in ten, at most two. The shorter line
counts. Lines of fewer than ten characters have exact repeats only.

Near lines are found by a segment-partition join. A line with threshold t is cut
into t + 1 segments (of its first elements; what remains belongs to none). t
edits cannot touch all of them, so a line within t edits holds one unchanged,
near the same place. Every line stands in the index under its segments (number
and content) and asks with those of its own substrings that can stand for a
segment of a line of its length or up to t less: the start of a substring differs
from the segment's by no more than the edits left of it, nor, counted from the
end, by more than the edits right of it. So every near pair meets, at any length;
a line has at most t + 1 entries and some 2 t (t + 1) questions.

Where lines meet, 56 parity bits of their words (or neighbouring characters) are
compared first, then histograms of their elements; what they allow is verified on
the texts by the edit distance along the diagonals in reach, in the task where a key's lines
meet. Lines of a key that links have joined are not compared again, so a key of n
lines gives fewer than n links, however many of its lines are near each other.
"""

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import components, cut_lineage

#: Lines of so many words are compared by words: one edit for every PER_EDIT of them, up to MOST.
WORDS, PER_EDIT, MOST = 8, 20, 8
#: Shorter ones by characters: one edit for every PER_CHARACTER, up to EDITS.
PER_CHARACTER, EDITS = 10, 2
BITS = 56
#: Bits of the map of line names that texts are read past: eight a name, within these bounds. A fuller map only lets more pass to a join.
MAP_BITS = (1 << 16, 1 << 27)
#: Distinct lines a task remembers so as to index a repeated line once; emptied when full, repeats are then removed later.
SEEN = 200_000
#: Characters of the texts that are worked on at once.
AT_ONCE = 1 << 20
#: Lines of one key that are compared at once, and about how many characters of them.
BLOCK, BLOCK_CHARACTERS = 2048, 1 << 22
#: So many lines are compared without a look at the histograms of their elements.
FEW = 2
#: A line that stands this often is joined with its copies without a shuffle, if there are not more than HOT_LINES such lines.
HOT_COPIES, HOT_LINES = 100_000, 10_000
#: What a blank line consists of, besides its end.
BLANK = " \t\x0b\f\r"
_B = 0x9E3779B97F4A7C15
_POWER = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def allowed(n: int, by_words: bool) -> int:
    """Edits within which a line of n elements and a longer one are near."""
    return min(MOST, max(1, n // PER_EDIT)) if by_words else min(EDITS, n // PER_CHARACTER)


def segments(n: int, by_words: bool) -> list[tuple[int, int]]:
    """(start, length) of the segments of a line of n elements; lines of one threshold have equally long ones, if that is above 1."""
    t = allowed(n, by_words)
    size = (PER_EDIT * t if by_words and t > 1 else n) // (t + 1)
    return [(i * size, size) for i in range(t + 1)]


def probes(n: int, by_words: bool) -> set[tuple[int, int, int]]:
    """(segment, start, length) of the substrings with which a line of n elements asks, besides its own segments."""
    found = set()
    for m in range(max(WORDS if by_words else PER_CHARACTER, n - (MOST if by_words else EDITS)), n + 1):
        t, more = allowed(m, by_words), n - m
        if more <= t:
            for i, (p, size) in enumerate(segments(m, by_words)):
                low, high = max(p - i, p + more - (t - i)), min(p + i, p + more + (t - i))
                found |= {(i, q, size) for q in range(max(0, low), min(n - size, high) + 1)}
    return found - {(i, p, size) for i, (p, size) in enumerate(segments(n, by_words))}


@lru_cache(maxsize=20_000)
def _pattern(n: int, by_words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Starts, lengths and seeds of all keys of a line of n elements, its own segments first, and how many these are."""
    own = [(i, p, size) for i, (p, size) in enumerate(segments(n, by_words))]
    number, start, size = np.array(own + sorted(probes(n, by_words)), np.int64).reshape(-1, 3).T
    seed = (number.astype(np.uint64) * np.uint64(2) + np.uint64(by_words)) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
    return start, size, seed, len(own)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B and 1/B to the powers 0 .. n - 1, modulo 2 ** 64."""
    if len(_POWER[0]) < n:
        for k, base in enumerate((_B, pow(_B, -1, 2 ** 64))):
            _POWER[k] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16), base, np.uint64))))
    return _POWER[0][:n], _POWER[1][:n]


#: Characters that part words, for str.split() as here; the last place stands for all further ones.
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _words(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each line has, and a hash of each word of all lines, from sums over their characters."""
    code = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = ~_SPACE[np.minimum(code, len(_SPACE) - 1)]
    edge = np.flatnonzero(np.diff(inside, prepend=False))  # a word's first character, then the one after its last
    begin, end = edge[::2], edge[1::2]
    line_end = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    many = np.diff(np.searchsorted(begin, line_end), prepend=0)
    value = np.empty(len(begin), np.uint64)
    cut = np.searchsorted(begin, np.arange(0, len(code) + AT_ONCE, AT_ONCE)).tolist()
    for k, m in zip(cut, cut[1:]):
        if k < m:
            first, a, b = begin[k], begin[k:m] - begin[k], end[k:m] - begin[k]
            number = _mixed(code[first:end[m - 1]].astype(np.uint64) + np.uint64(1))
            up, down = _powers(len(number) + 1)
            ahead = np.concatenate((np.zeros(1, np.uint64), np.cumsum(number * up[:len(number)])))
            value[k:m] = _mixed((ahead[b] - ahead[a]) * down[a] + (b - a).astype(np.uint64))
    return many, value


def keys_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, own, tag) of all keys of the lines: the line's number, whether the key is one of its segments, limit and parity bits."""
    count, word = _words(lines)
    by_words = count >= WORDS
    worded = by_words.tolist()
    letters = "".join(s for s, by in zip(lines, worded) if not by).encode("utf-32-le", "surrogatepass")
    # all word lines, then all character lines, as one sequence of numbers
    number = np.concatenate((word[np.repeat(by_words, count)], _mixed(np.frombuffer(letters, np.uint32).astype(np.uint64) + np.uint64(1))))
    order = np.concatenate((np.flatnonzero(by_words), np.flatnonzero(~by_words)))
    size = np.where(by_words, count, np.fromiter(map(len, lines), np.int64, len(lines)))[order]
    by_line = by_words[order]
    begin = np.cumsum(size) - size
    up, down = _powers(len(number) + 1)
    ahead = np.concatenate((np.zeros(1, np.uint64), np.cumsum(number * up[:len(number)])))
    # lines of one kind and length have one pattern of starts, lengths and seeds
    kind = size * 2 + by_line
    kinds, which = np.unique(kind, return_inverse=True)
    patterns = [_pattern(int(k) >> 1, bool(k & 1)) if k & 1 or k >> 1 >= PER_CHARACTER else None for k in kinds.tolist()]
    width = np.array([0 if pat is None else len(pat[0]) for pat in patterns], np.int64)
    flat = [np.concatenate([pat[c] for pat in patterns if pat is not None] or [np.zeros(0, np.int64)]) for c in range(3)]
    base, owned = np.cumsum(width) - width, np.array([0 if pat is None else pat[3] for pat in patterns], np.int64)
    many = width[which]
    row = np.repeat(np.arange(len(order)), many)
    within = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = base[which[row]] + within
    start, length, seed = flat[0][at] + begin[row], flat[1][at], flat[2][at].astype(np.uint64)
    key = _mixed((ahead[start + length] - ahead[start]) * down[start] + seed)
    own = within < owned[which[row]]
    # parity bits: of words, or of neighbouring characters; an edit changes two or four of them
    worded_elements = int(size[by_line].sum())
    who = np.repeat(np.arange(len(order)), size)
    bit = np.empty(len(number), np.uint64)
    bit[:worded_elements] = _mixed(number[:worded_elements])
    tail = number[worded_elements:]
    bit[worded_elements:-1] = _mixed(tail[:-1] * np.uint64(_B) + tail[1:])
    counts = np.ones(len(number), bool)
    ends = np.cumsum(size[~by_line]) - 1 + worded_elements
    counts[ends] = False  # the last character of a line has no neighbour
    odd = np.zeros((len(order), 64), np.uint8)
    odd[:, 8:] = np.bincount(who[counts] * BITS + (bit[counts] % np.uint64(BITS)).astype(np.int64), minlength=BITS * len(order)).reshape(-1, BITS) & 1
    tag = np.packbits(odd, axis=1).view(">i8").ravel().astype(np.int64)
    tag |= np.array([allowed(int(k) >> 1, bool(k & 1)) * (2 if k & 1 else 4) for k in kinds.tolist()], np.int64)[which] << BITS
    return order[row], key.view(np.int64), own, tag[row]


def within(a: str | list[str], b: str | list[str], most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    On each of the 2 * most + 1 diagonals around the first, the furthest place
    that so many edits reach is followed, edit by edit; it only moves on, so no
    more than 2 * most + 1 elements are compared for each place, and hardly more
    than one where few edits part the sequences.
    """
    if len(a) < len(b):
        a, b = b, a
    rows, columns = len(a), len(b)
    last = rows - columns
    if last > most:
        return most + 1
    # the furthest row on each diagonal (row less column), with -1 for none, from -most - 1 to most + 1
    mid = most + 1
    reached = [-1] * (2 * mid + 1)
    for edits in range(most + 1):
        before = reached[:]
        left = most - edits
        for d in range(max(-edits, last - left), min(edits, last + left) + 1):
            k = mid + d
            i = max(before[k] + 1, before[k - 1] + 1, before[k + 1]) if edits else 0  # replaced, left out, put in
            if i < d or i < 0:
                continue
            end = min(rows, columns + d)
            i = min(i, end)
            while i < end and a[i] == b[i - d]:
                i += 1
            if d == last and i == rows:
                return edits
            reached[k] = i
    return most + 1


def elements(line: str) -> tuple[str | list[str], bool]:
    """What a line is compared by, and whether that is its words."""
    words = line.split()
    return (words, True) if len(words) >= WORDS else (line, False)


def close(x: tuple[str | list[str], bool], y: tuple[str | list[str], bool]) -> bool:
    """Whether lines of these elements are near."""
    if x[1] != y[1]:
        return False
    most = allowed(min(len(x[0]), len(y[0])), x[1])
    return most > 0 and within(x[0], y[0], most) <= most


def near(x: str, y: str) -> bool:
    """Whether two lines are near."""
    return x == y or close(elements(x), elements(y))


def _name(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), seed=42)


def _lines(text: str | None) -> list[str]:
    """Lines that can have near ones."""
    return [s for s in text.split("\n") if len(s) >= PER_CHARACTER and not s.isspace()] if text else []


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    """The texts of the batches, some AT_ONCE characters at a time."""
    for batch in batches:
        some: list[str | None] = []
        size = 0
        for text in batch.column(0):
            some.append(text.as_py())
            size += len(some[-1] or "")
            if size > AT_ONCE:
                yield some
                some, size = [], 0
        if some:
            yield some


def _keys(docs: DataFrame) -> DataFrame:
    """Rows (key, line, tag) of all lines; a repeated line may come once a task. A key's lowest bit is 0 for a segment of the line, else 1."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for texts in _portions(batches):
            names, lines = [], []
            for text in texts:
                for s in _lines(text):
                    name = _name(s)
                    if name not in seen:
                        seen.add(name)
                        names.append(name)
                        lines.append(s)
            if len(seen) > SEEN:
                seen.clear()
            if lines:
                line, key, own, tag = keys_of(lines)
                yield pa.RecordBatch.from_arrays([pa.array(key & ~1 | ~own), pa.array(np.array(names, np.uint64).view(np.int64)[line]), pa.array(tag)], names=["key", "line", "tag"])

    return docs.select("text").mapInArrow(made, "key long, line long, tag long")


class _Shared:
    """Passes on the rows of keys under which several lines meet, one of them by a segment, from rows in the order of key, segments first.

    A key's rows are held back only until its second line comes, however many
    there are; a line that several tasks sent counts once in a batch.
    """

    def __init__(self) -> None:
        self.key: int | None = None
        self.state = "first"  # or "several", or "skip" if no line has the key as a segment
        self.held: tuple = ()

    def rows(self, key: np.ndarray, line: np.ndarray, own: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(key):
            return key, line, own, tag
        goes_on = self.state if self.key == key[0] else None
        if goes_on == "first":  # the line that waits goes first
            key, line, own, tag = (np.concatenate(([h], c)) for h, c in zip(self.held, (key, line, own, tag)))
            goes_on = None
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begins, len(key)))
        differ = np.minimum.reduceat(line, begins) != np.maximum.reduceat(line, begins)  # a line can both have a key and ask for it
        good = own[begins] & differ
        if goes_on is not None:
            good[0] = goes_on == "several"
        last = begins[-1]
        if len(begins) > 1 or goes_on is None:
            self.state = "skip" if not own[last] else "several" if differ[-1] else "first"
        self.key, self.held = int(key[last]), (key[last], line[last], own[last], tag[last])
        keep = np.repeat(good, size)
        key, line, own, tag = (c[keep] for c in (key, line, own, tag))
        order = np.lexsort((~own, line, key))
        key, line, own, tag = (c[order] for c in (key, line, own, tag))
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        return key[once], line[once], own[once], tag[once]


def _met(docs: DataFrame) -> DataFrame:
    """Rows (key, line, own, tag) of lines that meet others; keys are dealt and put in order once."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _Shared()
        for batch in batches:
            key, line, tag = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            found = shared.rows(key >> 1, line, key & 1 == 0, tag)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["key", "line", "own", "tag"])

    # one column of numbers is put in order without comparing rows
    dealt = _keys(docs).repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    return cut_lineage(dealt.mapInArrow(several, "key long, line long, own boolean, tag long"))


def _texts_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(tid, line, n, s) of the lines with these hashes; the texts are read past a bit map of bounded size."""
    names = cut_lineage(names)
    size = MAP_BITS[0]
    while size < min(MAP_BITS[1], 8 * names.count()):
        size *= 2
    bits = names.select(F.pmod("line", F.lit(size)).alias("b")).groupBy(F.floor(F.col("b") / 64).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("v"))
    table = np.zeros(size // 64, np.int64)
    for r in bits.toLocalIterator():  # at most MAP_BITS / 64 rows
        table[r["at"]] = r["v"]
    held = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _portions(batches):
            lines = list(dict.fromkeys(chain.from_iterable(map(_lines, texts))))
            name = np.fromiter(map(_name, lines), np.uint64, len(lines))
            bit = name % np.uint64(size)
            known = held.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)
            out = {lines[k]: name[k] for k in np.flatnonzero(known).tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(out.values()), np.uint64).view(np.int64)), pa.array(list(out), pa.string())], names=["line", "s"])

    rows = docs.select("text").mapInArrow(found, "line long, s string").join(names, "line", "left_semi").distinct()
    return cut_lineage(rows.select(F.monotonically_increasing_id().alias("tid"), "line", F.length("s").alias("n"), "s"))


def _histogram(x: tuple[str | list[str], bool]) -> np.ndarray:
    """How many of a line's elements fall into each of 256 classes, which differ between processes."""
    return np.bincount(np.fromiter(map(hash, x[0]), np.int64, len(x[0])) & 255, minlength=256)


def links_of(rows: list[tuple[int, bool, int, int, str]], cross: bool) -> list[tuple[int, int]]:
    """(u, v) of near lines among rows (tid, own, tag, side, text) of one key, segments first; with ``cross`` only lines of two sides are compared.

    Lines that links have joined are not compared again, so there are fewer links
    than rows, and every two near lines are joined by them.
    """
    n, found = len(rows), []
    if n == 2:  # most keys
        (u, own, x, one, s), (v, _, y, two, r) = rows
        if u == v or not own or cross and one == two or ((x ^ y) & ((1 << BITS) - 1)).bit_count() > min(x >> BITS, y >> BITS):
            return []
        return [(min(u, v), max(u, v))] if close(elements(s), elements(r)) else []
    known: list[tuple | None] = [None] * n
    held: list[np.ndarray | None] = [None] * n
    label = np.arange(n)
    tid, tag, side = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3))
    bits, most = tag & np.int64((1 << BITS) - 1), tag >> BITS
    for i in range(n - 1):
        if not rows[i][1]:
            break  # only rows without the segment follow
        ok = label[i + 1:] != label[i]
        if cross:
            ok &= side[i + 1:] != side[i]
        at = np.flatnonzero(ok) + i + 1
        at = at[np.bitwise_count(bits[at] ^ bits[i]) <= np.minimum(most[at], most[i])]
        if not len(at):
            continue
        for k in (i, *at.tolist()):
            known[k] = known[k] or elements(rows[k][4])
        if len(at) > FEW:  # no edit adds or removes more than one element
            for k in (i, *at.tolist()):
                if held[k] is None:
                    held[k] = _histogram(known[k])
            limit = np.minimum(most[at], most[i]) // (2 if known[i][1] else 4)
            for begin in range(0, len(at), 256):
                part = slice(begin, begin + 256)
                apart = np.stack([held[k] for k in at[part].tolist()]) - held[i]
                limit[part] -= np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))
            at = at[limit >= 0]
        for j in at.tolist():
            if label[j] == label[i]:
                continue
            if tid[i] != tid[j]:
                if not close(known[i], known[j]):
                    continue
                found.append((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
            label[label == label[j]] = label[i]
    return found


def _links(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) that join all near lines, from rows (key, line, own, tag) of lines that meet.

    Texts go to the tasks with their keys and are verified there; of a key with n
    lines fewer than n links leave a task. A key with many lines or long ones is
    dealt into blocks, and every two blocks meet in a task.
    """
    size = (met.join(texts.select("line", "n"), "line").groupBy("key")
            .agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_CHARACTERS)).cast("int").alias("blocks")).where("blocks > 1"))
    rows = met.join(texts, "line").join(cut_lineage(size), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("key", "tid", "own", "tag", "block", "s", other)
    rows = rows.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "tid", "own", "tag", "block", "s")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, found = None, [], []
        for batch in chain(batches, [None]):
            if batch is not None:
                for key, a, b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    if (key, a, b) != group:
                        found += links_of(held, group[1] != group[2]) if held else []
                        group, held = (key, a, b), []
                    held.append(row)
            elif held:
                found += links_of(held, group[1] != group[2])
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                found = []

    dealt = rows.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", F.desc("own"), "tid")
    return dealt.mapInArrow(linked, "u long, v long").distinct()


def line_classes(docs: DataFrame) -> DataFrame:
    """(m, root): the digest of each line that has another line near it, and the number of its class."""
    docs = docs.select(F.col("text").cast("string").alias("text"))
    met = _met(docs)
    texts = _texts_of(docs, met.select("line").distinct())
    roots = components(_links(met, texts))
    return roots.join(texts.withColumnRenamed("tid", "node"), "node").select(digest(F.col("s")).alias("m"), "root")


def digest(s: Column) -> Column:
    return F.unhex(F.md5(s.cast("binary")))


def _row_key() -> Column:
    """Sixteen bytes that tell documents with another id or text apart."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return digest(name)


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(row, drops): for each document with lines to drop, an array of (pos, first) by pos.

    ``first`` is doc_id:pos of the line that stays, the class's first in the
    order of doc_id (null last), a digest of the row and position. ``row`` is made of
    doc_id and the text's digest: repeated rows are treated alike.
    """
    named = docs.select(_row_key().alias("row"), F.col("doc_id").cast("long").alias("doc"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("all"))
    lines = cut_lineage(named.select("row", "doc", F.posexplode("all").alias("pos", "s"))  # the text's digest once, not once a line
                        .where(F.ltrim("s", F.lit(BLANK)) != "").select("row", "doc", "pos", digest(F.col("s")).alias("m")))
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "row", "pos")
    each = lines.groupBy("m").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    each = cut_lineage(each.join(line_classes(docs), "m", "left").withColumn("class", F.coalesce(F.encode(F.col("root").cast("string"), "UTF-8"), F.col("m"))).drop("root"))
    kept = each.groupBy("class").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where("all > 1")
    multi = each.join(kept, "class").select("m", "n", F.col("kept.row").alias("row0"), F.col("kept.pos").alias("pos0"),
                                            F.concat_ws(":", F.coalesce(F.col("kept.doc").cast("string"), F.lit("")), F.col("kept.pos").cast("string")).alias("first"))
    multi = cut_lineage(multi)
    hot = multi.where(F.col("n") > HOT_COPIES)
    if 0 < hot.count() <= HOT_LINES:  # the copies of a very common line stay where they are; lines as common as that are few
        met = lines.join(multi.where(F.col("n") <= HOT_COPIES), "m").unionByName(lines.join(F.broadcast(hot), "m"))
    else:
        met = lines.join(multi, "m")
    gone = met.where("row <> row0 OR pos <> pos0").select("row", F.struct("pos", "first").alias("d")).distinct()
    return gone.groupBy("row").agg(F.sort_array(F.collect_list("d")).alias("drops"))


def _joined(docs: DataFrame) -> DataFrame:
    drops = repeated_lines(docs)
    named = docs.withColumn("_row", _row_key())
    met = named.join(drops.withColumnRenamed("row", "_r"), F.col("_row") == F.col("_r"), "left")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = F.coalesce(F.expr("transform(drops, d -> d.pos)"), F.array().cast("array<int>"))
    # bound once: a line is fetched by its number, and numbers are subtracted as sets
    left = F.transform(F.array(F.split(text, "\n")), lambda all_: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), gone), lambda i: F.element_at(all_, i + 1)), "\n"))[0]
    return met.withColumn("_left", F.when(F.size(gone) > 0, left).otherwise(F.col("text").cast("string")))


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, text (what stays) and drops.

    ``drops`` lists every dropped line as position=doc_id:position of the line of
    its class that stays, comma-joined. Of lines under ten characters exact repeats
    are dropped; blank lines stay. A null
    text has no lines and stays null; an empty one has one empty line. Repeated
    rows get the same result; other columns are ignored; an empty table gives no
    rows. Very long lines are compared whole.
    """
    out = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return out.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.col("_left").alias("text"),
                      F.coalesce(F.expr("array_join(transform(drops, d -> concat(d.pos, '=', d.first)), ',')"), F.lit("")).alias("drops"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; documents of which nothing but white space stays go.

    A document that held nothing else before (null, empty or blank) stays as it is.
    """
    met = _joined(docs.select(F.struct("*").alias("_doc"), "doc_id", "text"))
    emptied = F.coalesce(F.size("drops") > 0, F.lit(False)) & (F.trim(F.regexp_replace("_left", r"\s+", " ")) == "")
    return met.where(~emptied).select(*[F.col("_left").alias("text") if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns])
