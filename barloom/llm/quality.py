"""Document quality from bytes: a small convolutional network, trained and run in numpy.

A text is cut into chunks of 256 bytes that overlap by 64, up to its last byte.
Filters over six neighbouring bytes slide through a chunk, each keeps its
maximum, and a hidden layer turns the maxima into the chunk's logit. The
document's probability is a logistic function of the mean logit of all its
chunks, fitted on documents that the filters did not see.

A filter over six bytes is three filters over byte pairs, and a filter's answer
to each of the 65,536 pairs is tabulated once, so that scoring is table lookups.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.llm.convnet import Net, learn, logistic, logits, random_net

CHUNK, OVERLAP, WIDTH = 256, 64, 6
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Labelled documents of each class that are drawn for training, by the order of a hash of their id.
SAMPLE = 1200
#: Chunks of one document that take part in a training round, spread evenly over the whole of it, and shorter excerpts
#: of the good ones beside them, since a short text shows few patterns without being poor.
TRAIN_CHUNKS, EXCERPTS, ROUNDS = 8, 4, 5
THRESHOLD = 0.3


def pair_tables(net: Net) -> list[np.ndarray]:
    """Answers of the filters to each pair of neighbouring bytes (257 x 257), for the three places of a pair."""
    single = [net.embed @ net.conv[k] for k in range(WIDTH)]
    return [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(257 * 257, FILTERS).astype(np.float32) for k in range(0, WIDTH, 2)]


def chunks(text: bytes) -> np.ndarray:
    """All chunks of a text as rows of CHUNK byte values, 256 behind its end; an empty text has one such row."""
    raw = np.frombuffer(text, np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, 256, np.int32)
    padded[:len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


def maxima(rows: np.ndarray, tables: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Largest answer of every filter in every chunk, over all its places, at least 0."""
    out = np.empty((len(rows), FILTERS), np.float32)
    for k in range(0, len(rows), 32):
        part = rows[k:k + 32]
        pair = part[:, :-1] * 257 + part[:, 1:]
        last = CHUNK - WIDTH + 1
        answer = tables[0][pair[:, 0:last]]
        answer += tables[1][pair[:, 2:last + 2]]
        answer += tables[2][pair[:, 4:last + 4]]
        out[k:k + 32] = answer.max(axis=1)
    return np.maximum(out + bias, 0)


def scores(net: Net, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
    """Probability of label 1 for each text."""
    rows = [chunks(t) for t in texts]
    ends = np.cumsum([len(r) for r in rows])
    value = logits(net, maxima(np.concatenate(rows), tables, net.bias))
    mean = np.add.reduceat(value, np.r_[0, ends[:-1]]) / np.diff(np.r_[0, ends])
    return net.odds(mean)


def _spread(rows: np.ndarray, k: int) -> np.ndarray:
    return rows[np.unique(np.linspace(0, len(rows) - 1, k).round().astype(int))]


def _excerpts(text: bytes, rng: np.random.Generator) -> list[np.ndarray]:
    """Random passages of 8 to 200 bytes, short ones as often as long ones, each as one chunk."""
    found = []
    for size in np.exp(rng.uniform(np.log(8), np.log(200), EXCERPTS)).astype(int):
        begin = int(rng.integers(0, max(1, len(text) - size + 1)))
        found.append(chunks(text[begin:begin + int(size)]))
    return found


def train(texts: list[bytes], labels: list[int], seed: int = 5) -> Net:
    """Fit the network on four fifths of the texts and the final logistic function on the rest.

    With fewer than two classes the result is the constant share of label 1
    (0.5 without any label).
    """
    rng = np.random.default_rng(seed)
    net = random_net(rng, 257, EMBED, WIDTH, FILTERS, HIDDEN)
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.a, net.b = 0.0, float(np.log(share / (1 - share)))
        return net
    order = rng.permutation(len(texts))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    rows = [np.concatenate([_spread(chunks(texts[i]), TRAIN_CHUNKS), *(_excerpts(texts[i], rng) if y[i] else [])]) for i in used]
    x = np.concatenate(rows)
    target = np.repeat(y[used], [len(r) for r in rows])
    # each class, and in it each document, has the same total weight
    weight = np.repeat(1 / np.array([len(r) for r in rows]), [len(r) for r in rows])
    for label in (0, 1):
        weight[target == label] /= max(weight[target == label].sum(), 1e-9)
    weight *= len(x) / 2
    learn(net, x, target, weight, rng, ROUNDS)
    tables = pair_tables(net)
    mean = np.array([logits(net, maxima(chunks(texts[i]), tables, net.bias)).mean() for i in held])
    net.a, net.b = logistic(mean, y[held])
    return net


def held_out(doc_id="doc_id"):
    """The rows that no label is learned from."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """Train on at most ``sample`` documents of each label, none of them held out.

    The sample is the documents of smallest id hash, so it is spread over the
    whole table and the same on every run. Repeated and null labels or ids are
    left out of it; a document with both labels counts for neither.
    """
    one = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
           .agg(F.min("quality").alias("y"), F.max("quality").alias("y1")).where("y = y1").select("doc_id", "y").where(~held_out()))
    drawn = [one.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = (plain.join(F.broadcast(drawn), "doc_id")  # at most 2 * sample rows of two numbers
            .groupBy("doc_id", "y").agg(F.max("text").alias("text")).orderBy("doc_id").collect())
    return train([r["text"].encode() for r in rows], [int(r["y"]) for r in rows])


def quality_scores(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with the added columns ``quality_score`` and ``quality_predicted``; a narrow map over whole texts.

    Null texts are scored like empty ones. Columns of ``docs`` with these two
    names are replaced; all others stay as they are.
    """
    base = docs.drop("quality_score", "quality_predicted")
    held = base.sparkSession.sparkContext.broadcast(net)  # weights only: about 10,000 numbers

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = pair_tables(held.value)
        for texts in batches:
            raw = [(t or "").encode() for t in texts]
            out = np.empty(len(raw))
            k = 0
            while k < len(raw):  # some hundred kilobytes at a time
                n, size = k, 0
                while n < len(raw) and (n == k or size + len(raw[n]) < 400_000):
                    size += len(raw[n])
                    n += 1
                out[k:n] = scores(held.value, raw[k:n], tables)
                k = n
            yield pd.Series(out)

    scored = base.withColumn("quality_score", F.pandas_udf(score, "double")(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.withColumn("quality_predicted", (F.col("quality_score") >= THRESHOLD).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Repeated rows and null doc_ids stay rows of their own; null and empty texts
    get the score of a text without bytes; an empty table gives no rows. Without
    usable labels every score is the share of label 1, or 0.5.
    """
    net = fit(docs, labels)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return quality_scores(plain, net).select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                                             F.col("quality_predicted").alias("predicted"))
