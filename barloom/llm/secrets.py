"""Secret scans: fixed patterns, and a character network over every other candidate in its context.

The patterns give the base spans (assign, access, hex). A candidate is any run
of letters, digits and ``+/_.-`` of twelve or more characters with a letter and
a digit in it. The network sees a candidate whole, in windows of 64 characters
that overlap, each with 24 characters of context on both sides; a candidate's
logit is its windows' largest. Its training labels are the pattern findings: a
candidate that a base span overlaps is a secret, another is not. Every window is
also seen with its context blanked, in training as in scoring, so that a secret
is found by what it looks like as well as by what stands around it; the larger
logit counts. The probability is calibrated on documents that
the weights did not see, and the threshold is even odds, or as much lower as is
needed to find ``RECALL`` of their findings. Candidates over it that no base span overlaps are
added as spans of kind ``model``.

All candidates of the table take part, those of two thirds of the documents in
the weights, the others in calibration and threshold. Training is in rounds: the
candidates are dealt into shards, each shard makes its steps from the weights of
the round before, and weights and moments are averaged by the shards' windows.
Calibration and threshold come from how many candidates of each label stand at
each logit, logits being read in steps of 1 / ``GRADES`` everywhere.
"""

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from barloom.llm.common import cut_lineage
from barloom.llm.convnet import Adam, Net, logistic, logits, random_net

KINDS = ("assign", "access", "hex", "model")
# fixed values: the base patterns of the scan
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more, which are whole runs
KEYWORDS = ("password", "passwd", "secret", "token", "api")
INSIDE, CONTEXT, LEAST = 64, 24, 12
EMBED, WIDTH, FILTERS, HIDDEN, ROUNDS = 8, 5, 24, 12, 12
#: Windows of a shard, and the most shards, which then grow; windows that are put in random order together, windows of a step.
SHARD, SHARDS, BLOCK, STEP = 8000, 64, 4096, 128
#: Logits are whole numbers of 1 / GRADES, and lie within TOP of zero.
GRADES, TOP = 512, 64
RECALL = 0.98
_AFTER = re.compile(r"[A-Za-z0-9+/_.-]+")
_DIGIT = re.compile("[0-9]")
_LETTER = re.compile("[A-Za-z]")


@dataclass
class Scanner:
    net: Net
    threshold: float  # over 1: nothing is added


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern findings, kinds as numbers, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of candidate characters with a digit and a letter, found from their digits."""
    found, at = [], 0
    while m := _DIGIT.search(text, at):
        begin = m.start()
        while begin > at and _AFTER.match(text, begin - 1, begin):
            begin -= 1
        end = _AFTER.match(text, m.start()).end()
        if end - begin >= LEAST and _LETTER.search(text, begin, end):
            found.append((begin, end))
        at = end
    return found


def windows(text: str, begin: int, end: int) -> np.ndarray:
    """Codes of the windows of a candidate: ASCII codes (127 for all others), 128 more inside the candidate, 256 outside the text."""
    codes = np.minimum(np.frombuffer(text[max(0, begin - CONTEXT):end + CONTEXT].encode("utf-32-le", "surrogatepass"), np.uint32), 127).astype(np.int32)
    lead = begin - max(0, begin - CONTEXT)
    codes[lead:lead + end - begin] += 128
    step = INSIDE // 2
    n = max(1, -(-(end - begin - INSIDE) // step) + 1)
    row = np.full((n - 1) * step + INSIDE + 2 * CONTEXT, 256, np.int32)
    row[CONTEXT - lead:CONTEXT - lead + len(codes)] = codes
    return np.lib.stride_tricks.sliding_window_view(row, INSIDE + 2 * CONTEXT)[::step]


def maxima(net: Net, rows: np.ndarray) -> np.ndarray:
    single = [net.embed @ net.conv[k] for k in range(WIDTH)]
    out = np.empty((len(rows), FILTERS))
    places = INSIDE + 2 * CONTEXT - WIDTH + 1
    for k in range(0, len(rows), 256):
        part = rows[k:k + 256]
        out[k:k + 256] = sum(single[j][part[:, j:j + places]] for j in range(WIDTH)).max(axis=1)
    return np.maximum(out + net.bias, 0)


def joined(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of sorted spans."""
    starts, ends = [], []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def blanked(rows: np.ndarray) -> np.ndarray:
    """The windows with spaces in place of their context."""
    return np.where(rows < 128, 32, rows)


def window_logits(net: Net, rows: np.ndarray) -> np.ndarray:
    value = np.maximum(logits(net, maxima(net, rows)), logits(net, maxima(net, blanked(rows))))
    return np.floor(np.clip(value, -TOP, TOP) * GRADES) / GRADES


def overlaps(union: tuple[list[int], list[int]], begin: int, end: int) -> bool:
    k = bisect_left(union[0], end) - 1
    return k >= 0 and union[1][k] > begin


def scan(texts: list[str], scanner: Scanner) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text, base ones and added ones, in order."""
    out, rows, where = [], [], []
    for k, text in enumerate(texts):
        spans = base_spans(text)
        out.append(spans)
        if scanner.threshold <= 1:
            union = joined(spans)
            for begin, end in candidates(text):
                if not overlaps(union, begin, end):
                    w = windows(text, begin, end)
                    rows.append(w)
                    where.append((k, begin, end, len(w)))
    if rows:
        value = scanner.net.odds(window_logits(scanner.net, np.concatenate(rows)))
        at = 0
        added: dict[int, list[tuple[int, int, int]]] = {}
        for k, begin, end, n in where:
            if value[at:at + n].max() >= scanner.threshold:
                added.setdefault(k, []).append((begin, 3, end))
            at += n
        for k, more in added.items():
            out[k] = sorted(out[k] + more)
    return out


FOUND = "doc_id long, n int, label boolean, part string, begin int, stop int"


def findings(docs: DataFrame) -> DataFrame:
    """All candidates (doc_id, n, label, part, begin, stop): ``part`` is the candidate with its context, at begin to stop there."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    union = joined(base_spans(text))
                    for n, (begin, end) in enumerate(candidates(text)):
                        first = max(0, begin - CONTEXT)
                        rows.append((doc, n, overlaps(union, begin, end), text[first:end + CONTEXT], begin - first, end - first))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "n", "label", "part", "begin", "stop"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(found, FOUND)


class _Shard:
    """One shard's steps of a round, from the weights that all shards start with."""

    def __init__(self, net: Net, row: np.ndarray, weight: tuple[float, float], seed: tuple[int, ...]):
        self.net, self.adam, self.weight = Net(**vars(net)), Adam(net), weight
        self.adam.unpack(self.net, row)
        self.rng = np.random.default_rng(seed)
        self.held: list[tuple[np.ndarray, bool]] = []
        self.waiting = self.n = 0

    def add(self, rows: np.ndarray, label: bool) -> None:
        for k in range(0, len(rows), BLOCK // 2):
            part = rows[k:k + BLOCK // 2]
            self.held += [(part, label), (blanked(part), label)]
            self.waiting += 2 * len(part)
            if self.waiting >= BLOCK:
                self.steps()

    def steps(self) -> None:
        if not self.held:
            return
        x = np.concatenate([r for r, _ in self.held])
        y = np.repeat([float(v) for _, v in self.held], [len(r) for r, _ in self.held])
        order = self.rng.permutation(len(x))
        for k in range(0, len(order), STEP):
            at = order[k:k + STEP]
            self.adam.step(self.net, x[at], y[at], np.where(y[at] > 0, self.weight[1], self.weight[0]))
        self.n += len(x)
        self.held, self.waiting = [], 0


def train(rows: DataFrame, many: dict[bool, int], seed: int = 3) -> Net:
    """Weights from all these candidates, of which ``many`` windows have each label. The driver gets one row of numbers a shard and round."""
    rng = np.random.default_rng(seed)
    net = random_net(rng, 257, EMBED, WIDTH, FILTERS, HIDDEN)
    adam = Adam(net)
    total = sum(many.values())
    weight = (0.5 * total / many[False], 0.5 * total / many[True])
    shards = min(SHARDS, -(-total // SHARD))
    order = F.xxhash64("doc_id", "n")
    dealt = (rows.select(F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("order"), "label", "part", "begin", "stop")
             .repartition(shards, "shard").sortWithinPartitions("shard", "order", "part", "begin").drop("order").persist(StorageLevel.MEMORY_AND_DISK))
    for k in range(ROUNDS):
        state = adam.packed(net)

        def stepped(batches: Iterator[pa.RecordBatch], state: np.ndarray = state, number: int = k) -> Iterator[pa.RecordBatch]:
            at, now = None, None
            out: list[tuple[int, int, bytes]] = []

            def end() -> None:
                if now is not None:
                    now.steps()
                    out.append((at, now.n, now.adam.packed(now.net).tobytes()))

            for batch in batches:
                for shard, label, part, begin, stop in zip(*(c.to_pylist() for c in batch.columns)):
                    if shard != at:
                        end()
                        at, now = shard, _Shard(net, state, weight, (seed, number, shard))
                    now.add(windows(part, begin, stop), label)
            end()
            cols = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()))], names=["shard", "n", "state"])

        made = sorted(dealt.mapInArrow(stepped, "shard int, n long, state binary").collect())  # SHARDS rows at most
        adam.unpack(net, sum(r["n"] * np.frombuffer(r["state"]) for r in made) / sum(r["n"] for r in made))
    dealt.unpersist()
    return net


def calibrated(rows: DataFrame, net: Net) -> Scanner:
    """Probability and threshold from all these candidates. The driver gets the counts of logits, of which there are 2 * TOP * GRADES at most."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, part, begin, stop = (c.to_pylist() for c in batch.columns)
            value = [max(float(window_logits(net, w[k:k + BLOCK]).max()) for k in range(0, len(w), BLOCK)) for w in map(windows, part, begin, stop)]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.bool_()), pa.array(value, pa.float64())], names=["label", "logit"])

    counts = (rows.select("label", "part", "begin", "stop").mapInArrow(top, "label boolean, logit double")
              .groupBy("label", "logit").agg(F.count("*").alias("n")).orderBy(F.desc("logit"), "label").collect())
    y, x, n = (np.array([r[k] for r in counts], float) for k in range(3))
    net.a, net.b = logistic(x, y, n)
    above = np.cumsum(n * y)
    least = x[np.flatnonzero(above >= np.ceil(RECALL * above[-1]))[0]]
    return Scanner(net, min(0.5, float(net.odds(least))))


def fit(docs: DataFrame) -> Scanner:
    """Learn from the candidates of all documents; without both labels among them nothing is added. Repeated rows count once."""
    rows = cut_lineage(findings(docs).distinct().withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0))
    n = F.greatest(F.ceil((F.col("stop") - F.col("begin") - INSIDE) / (INSIDE // 2)), F.lit(0)) + 1
    many = {(r["held"], r["label"]): int(r["n"]) for r in rows.groupBy("held", "label").agg(F.sum(n).alias("n")).collect()}
    if len(many) < 4:
        return Scanner(random_net(np.random.default_rng(0), 257, EMBED, WIDTH, FILTERS, HIDDEN), 2.0)
    net = train(rows.where("NOT held"), {label: 2 * many[False, label] for label in (False, True)})
    return calibrated(rows.where("held"), net)


def secret_scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Spans of every text: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) and n_model.

    Positions are code points, ends are exclusive; spans stand in order of their
    start, then of kind. Null texts are empty; repeated rows and null doc_ids
    stay rows; other columns are ignored; an empty table gives no rows. Whole
    texts are read, in a narrow map.
    """
    if scanner is None:
        scanner = fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(scanner)  # weights only, a few thousand numbers

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = scan([t or "" for t in part.column(1).to_pylist()], held.value)
                named = [[(kind, f"{KINDS[kind]}:{a}:{b}") for a, kind, b in spans] for spans in found]
                count = [[sum(kind == j for kind, _ in spans) for spans in named] for j in range(4)]
                sha = [hashlib.sha256(",".join(t for kind, t in spans if kind < 3).encode()).hexdigest() for spans in named]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in count[:3]), pa.array(sha, pa.string()),
                     pa.array([",".join(t for _, t in spans) for spans in named], pa.string()), pa.array(count[3], pa.int64())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
