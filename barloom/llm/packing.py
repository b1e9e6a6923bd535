"""Mixture-controlled packing of tokenized documents into fixed-length sequences.

Every source is a queue of its documents' tokens, and deficit round-robin takes
from the queues in turn: a window of ``WINDOW`` sequences owes each source its
target share of the window's tokens, whole tokens are served, and what is owed
beyond them is carried to the next window. Because documents may be cut, the
carried deficit stays below one token, and what source s has been served after k
windows has a closed form: with the running shares A_s of the sources before it,
``floor(k W (A_s + T_s) / T) - floor(k W A_s / T)``. The deficits of all windows
before it are thus known at any place of the stream, on whatever partition it
lies: where a document's tokens go follows from its place in its queue alone,
and no task waits for another.

Target shares are by default the sources' shares of all tokens, so that all
queues end in the last window. With other targets the sources end one after
another, and each stretch in between is packed in that way with the sources that
are left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.common import running_start, stored, tokenizer_path

SEQUENCE = 1024
#: Sequences of a window: shares hold to within a token over this many, and a source's turn in it is one run of tokens.
WINDOW = 16
#: Distinct words whose ids a worker keeps; the rarer ones go when it is full, which costs time only.
KEPT_WORDS = 500_000
#: Stands between words that the library is asked for together.
BETWEEN = "\n"
#: Tables of (queue, partition) totals of up to so many rows are sent to the ids; larger ones are joined with them.
SENT_ROWS = 100_000

# letters, digits and signs on which every Unicode version agrees; texts with others are left to the library as a whole
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(rf"[ -~\n\t\r{_LETTER}]*").fullmatch
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+").findall


class Ids:
    """Token ids of texts as little-endian bytes, by the library, with the ids of a word looked up once."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # the split above is the one of byte-level models; any other model gets whole texts
        self.by_word = "ByteLevel" in str(self.library.pre_tokenizer) and self.library.normalizer is None
        self.words: dict[str, bytes] = {}

    def _asked(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space but one blank before them, from one text with a line feed between any two.

        The split never joins a line feed with what stands beside it, so its id
        parts the words.
        """
        mark = self._asked([BETWEEN])[0]
        ids = np.frombuffer(self._asked([BETWEEN.join(words)])[0], self.type)
        ends = np.flatnonzero(ids == np.frombuffer(mark, self.type)[0]) if len(mark) == self.type.itemsize else ids
        if len(ends) != len(words) - 1:
            return self._asked(words)
        raw, wide = ids.tobytes(), self.type.itemsize
        return [raw[b * wide:e * wide] for b, e in zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)])]

    def batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split: dict[int, list[str]] = {}
        for k, t in enumerate(texts):
            if self.by_word and _PLAIN(t) and not any(s in t for s in self.special):
                split[k] = _SPLIT(t)
        here = set().union(*split.values())
        new = here.difference(self.words)
        if len(new) + len(self.words) > KEPT_WORDS:  # what these texts need again stays, and with it what is common
            self.words = {w: self.words[w] for w in here.difference(new)}
        blank = sorted(filter(str.isspace, new))
        plain = sorted(new.difference(blank))
        self.words.update(zip(blank, self._asked(blank)))
        for k in range(0, len(plain), 1000):
            self.words.update(zip(plain[k:k + 1000], self._together(plain[k:k + 1000])))
        for k, words in split.items():
            out[k] = b"".join(map(self.words.__getitem__, words))
        rest = [k for k in range(len(texts)) if k not in split]
        for k, ids in zip(rest, self._asked([texts[k] for k in rest])):
            out[k] = ids
        return out


_OPEN: dict[str, Ids] = {}


def opened(name_or_path: str) -> Ids:
    if name_or_path not in _OPEN:
        _OPEN[name_or_path] = Ids(name_or_path if "/" in name_or_path else tokenizer_path(name_or_path))
    return _OPEN[name_or_path]


def _tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents as ids with a closing 0, their queue, partition, and start among the partition's tokens of the queue."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, at = opened(tokenizer), TaskContext.get().partitionId(), {}
        end = np.zeros(1, tok.type).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = batch.slice(k, 500)
                packed = [b + end for b in tok.batch([t or "" for t in rows.column(2).to_pylist()])]
                size = [len(b) // tok.type.itemsize for b in packed]
                start = []
                for q, n in zip(rows.column(1).to_pylist(), size):
                    start.append(at.get(q, 0))
                    at[q] = start[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([part] * len(size), pa.int32()), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "queue", "part", "start", "size", "ids"])

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("queue"),
                        F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(ids, "doc_id long, queue string, part int, start long, size long, ids binary")


def stretches(totals: dict[str, int], targets: dict[str, float]) -> list[tuple[str, int, int, int, int, int]]:
    """(queue, x0, x1, lo, total, base): of each stretch between two ends of queues, the tokens [x0, x1) of a queue.

    ``lo`` is the number of tokens that the queues before it give to the stretch,
    ``total`` that of all, ``base`` that of the stretches before.
    """
    weight = {q: Fraction(targets[q]).limit_denominator(10 ** 6) for q in totals}
    if min(weight.values(), default=1) <= 0:
        raise ValueError("target shares must be positive")
    ends = sorted({Fraction(totals[q]) / weight[q] for q in totals if totals[q]})
    rows, base, gone = [], 0, dict.fromkeys(totals, 0)
    for end in ends:
        upto = {q: totals[q] if totals[q] <= weight[q] * end else int(weight[q] * end) for q in totals}
        lo, total = 0, sum(upto[q] - gone[q] for q in totals)
        for q in sorted(totals):
            if upto[q] > gone[q]:
                rows.append((q, gone[q], upto[q], lo, total, base))
                lo += upto[q] - gone[q]
        base, gone = base + total, upto
    return rows


def placed(begin: int, end: int, x0: int, x1: int, lo: int, total: int, base: int, window: int, sequence: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, place) of the runs into which the tokens [begin, end) of a queue fall, place being that in the whole stream."""
    full, size, x, stop = total // window, x1 - x0, max(begin, x0) - x0, min(end, x1) - x0

    def served(k: int, share: int) -> int:
        return window * k * share // total if k <= full else share

    k = min(full, x * total // (size * window)) if size else 0
    while x < stop:
        while k and served(k, lo + size) - served(k, lo) > x:
            k -= 1
        while served(k + 1, lo + size) - served(k + 1, lo) <= x:
            k += 1
        before = served(k, lo + size) - served(k, lo)
        last = min(stop, served(k + 1, lo + size) - served(k + 1, lo))
        place = base + window * k + served(k + 1, lo) - served(k, lo) + x - before
        while x < last:
            n = min(last - x, sequence - place % sequence)
            yield x0 + x, x0 + x + n, place
            x, place = x + n, place + n


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", sequence: int = SEQUENCE, window: int = WINDOW,
         targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``sequence`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Every sequence but the last is full; the last holds what is left. A null or
    empty text is its closing id alone. A null source (or a table without the
    column) is a queue of its own. Repeated rows and null doc_ids are documents
    like others, very long texts are cut like others, other columns are ignored,
    and an empty table gives no pieces. ``targets`` (source -> share, None for
    the null source) must name every source of the table.

    Texts are read once; their ids are kept in the shared folder. Only (queue,
    partition) totals are shuffled and added up, so a hot source is spread over
    all partitions that read it. The totals are sent to the ids where they are
    few enough (``SENT_ROWS``), otherwise joined with them.
    """
    docs_ids = stored(_tokenized(docs, tokenizer))
    parts = docs_ids.groupBy("queue", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), "n"))
    queues = parts.groupBy("queue").agg(F.sum("n").alias("x1"))
    spark = docs.sparkSession
    if targets is None:
        total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        plan = (running_start(queues.withColumn("one", F.lit(1)).withColumn("order", F.xxhash64("queue")), "one", "order", "x1")
                .select("queue", F.lit(0).cast("long").alias("x0"), "x1", F.col("start").alias("lo"), F.lit(total).cast("long").alias("total"), F.lit(0).cast("long").alias("base")))
    else:
        share = {("" if q is None else f"={q}"): w for q, w in targets.items()}
        named = {r["queue"]: r["x1"] for r in queues.where(F.col("queue").isin(list(share))).collect()}  # as many rows as targets
        if queues.where(~F.col("queue").isin(list(share))).limit(1).count():
            raise ValueError("targets must name every source")
        plan = spark.createDataFrame(stretches(named, share) or [], "queue string, x0 long, x1 long, lo long, total long, base long")
    plan = plan.select(F.col("queue").alias("q"), "x0", "x1", "lo", "total", "base")
    ahead = parts.select(F.col("queue").alias("q2"), F.col("part").alias("p2"), "ahead")
    begin = F.col("ahead") + F.col("start")
    ahead, plan = (F.broadcast(d) if d.count() <= SENT_ROWS else d for d in (ahead, plan))
    where = (docs_ids.join(ahead, (F.col("queue") == F.col("q2")) & (F.col("part") == F.col("p2")))
             .join(plan, (F.col("queue") == F.col("q")) & (begin < F.col("x1")) & (begin + F.col("size") > F.col("x0")))
             .select("doc_id", begin.alias("begin"), "size", "x0", "x1", "lo", "total", "base", "ids"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = opened(tokenizer).type
        for batch in batches:
            out: list[tuple] = []
            numbers = [batch.column(k).to_pylist() for k in range(8)]
            for doc, begin, size, x0, x1, lo, total, base, ids in zip(*numbers, batch.column(8)):
                wide = np.frombuffer(ids.as_buffer(), kind).astype("<u4")
                for a, b, place in placed(begin, begin + size, x0, x1, lo, total, base, window * sequence, sequence):
                    out.append((doc, a - begin, b - a, zlib.crc32(wide[a - begin:b - begin]), size, place // sequence, place % sequence))
            cols = zip(*out) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return where.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
