"""Exact token counts at every prefix of a text, by dynamic programming over the prefixes.

A byte-pair encoding of a prefix ends in exactly one piece, and that piece can
be told from what is already known: it must be one that the encoder leaves whole
and that it leaves unmerged beside the last piece of the shorter prefix. So
``count[i] = count[i - len(piece)] + cost(piece)`` gives the count of all
prefixes in one pass, without encoding any of them. No piece of the model holds
a space marker after another character, so a text falls into words that are
encoded alone: the table of a document is the running sum of its words' tables,
and a table is made once for each distinct word that a task meets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import tokenizer_path

MARK = "▁"
#: Words of which a worker keeps the tables; the store is emptied when full, which costs time only.
KEPT_WORDS = 800_000
#: Words up to this length are tabulated together as rows of a matrix, longer ones alone.
SIDE_BY_SIDE = 64


class PrefixTable:
    """Prefix token counts of texts under one sentencepiece byte-pair model."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("the model must be byte-pair encoding of unchanged text")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.dummy = norm.add_dummy_prefix
        self.bytes = spec.trainer_spec.byte_fallback
        # normal, user-defined and unused pieces take part in merges; marks and single bytes don't
        self.score = {p.piece: p.score for p in spec.pieces if p.type in (1, 4, 5)}
        ends: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        whole = any(MARK in p.lstrip(MARK) for p in self.score)
        self.words = re.compile(f"(?s).+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.totals: dict[str, int] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        self.built: dict[str, tuple | None] = {}
        self._trie()

    def marked(self, text: str) -> str:
        return (MARK if self.dummy else "") + text.replace(" ", MARK) if text else ""

    def merges(self, piece: str) -> tuple | None:
        """How the encoder builds a piece: (score, first part, last part) after each merge; None if it never does.

        The best-scored neighbours merge first, the leftmost among equals.
        """
        if piece in self.built:
            return self.built[piece]
        parts, steps, score = list(piece), [(0.0, piece[0], piece[-1])], self.score
        while len(parts) > 1:
            best = max(((score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            steps.append((best[0], parts[0], parts[-1]))
        self.built[piece] = out = tuple(steps) if len(parts) == 1 else None
        return out

    def cost(self, piece: str) -> int:
        if piece in self.score or not self.bytes:
            return 1
        return len(piece.encode())

    def stays(self, a: str, b: str) -> bool:
        """Whether two pieces side by side are what the encoder makes of their text.

        Both are built merge by merge in the encoder's order; they stay apart
        unless at some step the parts that touch would merge first.
        """
        left, right, i, j, score = self.merges(a), self.merges(b), 0, 0, self.score
        while True:
            x = left[i + 1][0] if i + 1 < len(left) else None
            y = right[j + 1][0] if j + 1 < len(right) else None
            cross = score.get(left[i][2] + right[j][1])
            if cross is not None and (x is None or cross > x) and (y is None or cross >= y):
                return False
            if x is None and y is None:
                return True
            if y is None or (x is not None and x >= y):
                i += 1
            else:
                j += 1

    def table(self, word: str) -> tuple[int, ...]:
        """Counts of the prefixes of 0, 1, 2 ... characters of a word."""
        counts, last, score, beside, lengths = [0], [""], self.score, self.beside, self.lengths
        for i in range(1, len(word) + 1):
            for n in (*lengths.get(word[max(0, i - 2):i], ()), 1):
                k = i - n
                if k < 0:
                    continue
                piece = word[k:i]
                if n > 1 and (piece not in score or self.merges(piece) is None):
                    continue
                if k:
                    pair = last[k], piece
                    fits = beside.get(pair)
                    if fits is None:
                        if len(beside) > 2 * KEPT_WORDS:
                            beside.clear()
                        fits = beside[pair] = self.stays(*pair)
                    if not fits:
                        continue
                counts.append(counts[k] + self.cost(piece))
                last.append(piece)
                break
            else:
                raise ValueError(f"no piece ends at character {i} of {word!r}")
        return tuple(counts)

    def _trie(self) -> None:
        """The pieces that the encoder can build, as a trie in sorted arrays, and a store of judged neighbours."""
        self.pieces = [p for p in self.score if self.merges(p) is not None]
        nodes: dict[str, int] = {"": 0}
        edges, ends = [], [-1]
        for k, p in enumerate(self.pieces):
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    edges.append((nodes[p[:n - 1]] << 21 | ord(p[n - 1]), nodes[p[:n]]))
                    ends.append(-1)
            ends[nodes[p]] = k
        edges.sort()
        self.edge = np.array([e for e, _ in edges] + [1 << 62], np.int64)
        self.child = np.array([c for _, c in edges] + [0], np.int32)
        self.ends = np.array(ends, np.int32)
        self.pair_key = np.full(1 << 20, -1, np.int64)
        self.pair_fits = np.zeros(1 << 20, bool)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stays`` for arrays of piece numbers; -1 is a character outside the vocabulary, which merges with nothing."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = (a.astype(np.int64) * 40503 + b) * 2654435761 >> 12 & 0xFFFFF
        new = (self.pair_key[slot] != key) & (a >= 0)
        fits = self.pair_fits[slot] | (a < 0)
        if new.any():
            unknown, where = np.unique(key[new], return_inverse=True)
            judged = np.array([self.stays(self.pieces[k >> 32], self.pieces[k & 0xFFFFFFFF]) for k in unknown.tolist()], bool)
            fits[new] = judged[where]
            self.pair_key[slot[new]] = key[new]
            self.pair_fits[slot[new]] = fits[new]
        return fits

    def side_by_side(self, words: list[str]) -> np.ndarray:
        """Tables of many words at once, as the rows of a matrix; entries after a word's end repeat nothing and stay 0."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max(initial=0))
        chars = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width).astype(np.int64)
        counts = np.zeros((len(words), width + 1), np.int32)
        last = np.full((len(words), width + 1), -1, np.int32)
        for k in range(width):
            row = np.flatnonzero(size > k)
            node = np.zeros(len(row), np.int64)
            for n in range(1, width - k + 1):
                live = size[row] >= k + n
                row, node = row[live], node[live]
                key = node << 21 | chars[row, k + n - 1]
                at = np.searchsorted(self.edge, key)
                found = self.edge[at] == key
                if n == 1 and not found.all():  # a character that no piece starts with, or that is none alone
                    self._outside(counts, last, chars, row[~found], k)
                row, node = row[found], self.child[at[found]].astype(np.int64)
                if not len(row):
                    break
                piece = self.ends[node]
                if n == 1 and (piece < 0).any():
                    self._outside(counts, last, chars, row[piece < 0], k)
                r, p = row[piece >= 0], piece[piece >= 0]
                if k and len(r):
                    fits = self._fit(last[r, k], p)
                    r, p = r[fits], p[fits]
                counts[r, k + n] = counts[r, k] + 1
                last[r, k + n] = p
        return counts

    def _outside(self, counts, last, chars, row, k) -> None:
        c = chars[row, k]
        size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) if self.bytes else 1
        counts[row, k + 1] = counts[row, k] + size
        last[row, k + 1] = -1

    def learn(self, words: set[str]) -> None:
        """Have the totals of these words in the store."""
        new = words.difference(self.totals)
        if len(self.totals) + len(new) > KEPT_WORDS:
            self.totals, new = {}, words
        short = sorted((w for w in new if len(w) <= SIDE_BY_SIDE), key=len)
        for k in range(0, len(short), 20_000):
            part = short[k:k + 20_000]
            counts = self.side_by_side(part)
            ends = counts[np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part))].tolist()
            self.totals.update(zip(part, ends))
        for w in new:
            if len(w) > SIDE_BY_SIDE:
                self.totals[w] = self.table(w)[-1]

    def counts(self, texts: list[str | None]) -> list[int]:
        """Token counts of whole texts."""
        out: list[int] = []
        for k in range(0, len(texts), 1000):
            split = [self.words(self.marked(t)) if t else [] for t in texts[k:k + 1000]]
            self.learn({w for words in split for w in words})
            out += [sum(map(self.totals.__getitem__, words)) for words in split]
        return out

    def prefixes(self, text: str | None) -> list[int]:
        """Token counts of ``text[:0]``, ``text[:1]``, ... ``text``."""
        if not text:
            return [0]
        out, base = [0], 0
        for word in self.words(self.marked(text)):
            t = self.table(word)
            out += [base + c for c in t[1:]]
            base += t[-1]
        if self.dummy:  # the marker in front is no character of the text
            del out[1]
        return out

    def fit(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        if not text:
            return 0
        if budget < 1:
            return 0
        base = at = best = 0
        for word in self.words(self.marked(text)):
            if base >= budget:
                break
            t = self.table(word) if base + len(word) * 4 > budget else None
            if t is None:
                best = at + len(word)
            else:
                best = max([best, *(at + k for k, c in enumerate(t) if base + c <= budget)])
            base += self.totals[word] if word in self.totals else self.table(word)[-1]
            at += len(word)
        return max(0, best - self.dummy)


_OPEN: dict[str, PrefixTable] = {}


def prefix_table(name_or_path: str) -> PrefixTable:
    """The table maker of a model, opened once for each worker."""
    if name_or_path not in _OPEN:
        path = name_or_path if "/" in name_or_path else tokenizer_path(name_or_path)
        _OPEN[name_or_path] = PrefixTable(path)
    return _OPEN[name_or_path]


def token_counts(docs: DataFrame, limit: int = 4096, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Count and truncation point of every text: doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    ``fit_chars`` is the length of the longest prefix with at most ``limit``
    tokens. A narrow map: no shuffle, and memory for one Arrow batch and the
    bounded word store. Null texts count as empty (0 bytes, 0 tokens); null or
    repeated doc_ids keep their rows; other columns are ignored; an empty table
    gives an empty result. Texts of any length are read whole.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = table.counts(texts)
            fit = [len(t or "") if k <= limit else table.fit(t, limit) for t, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                 pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_counts(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """The whole table of every text: doc_id and ``counts``, whose entry i is the token count of the first i characters."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                counts = [table.prefixes(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.list_(pa.int32()))], names=["doc_id", "counts"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(tables, "doc_id long, counts array<int>")
