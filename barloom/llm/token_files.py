"""Token ids as files: every document one small frame, all of them compressed with one shared dictionary.

A data set is a folder of three tables, written and committed by Spark so that a
lost executor leaves no half file behind:

* ``dictionary``: one row with the tokenizer, the closing id, the width of an id,
  and a zstandard dictionary trained on the serialized ids of a sample;
* ``blocks``: the ids, some hundred kilobytes of frames a row. A frame is one document's
  ids as little-endian integers, compressed on its own. Beside the frames stand
  the hash of the dictionary that they need, the documents' ids, token counts and
  the offsets of their frames, so that one short document is read by fetching its
  block's index and decompressing its frame alone;
* ``parts``: the place of each part in the whole stream of ids.

Documents lie in ascending doc_id order within a part, and parts follow each
other in that order. Smallest and largest doc_id of a block are columns of their
own, so a search by id skips all other row groups.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.llm.common import cut_lineage, tokenizer_path
from barloom.session import shared_folder

END = 2
LEVEL = 3
#: Bytes of the dictionary, documents it is trained on (the smallest of a hash), characters of each that take part.
DICTIONARY_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 64 * 1024, 2000, 8000
#: A block is closed at this many bytes of frames or documents; so many bytes of blocks are held in memory to write or read a file.
BLOCK_BYTES, BLOCK_DOCS, GROUP_BYTES = 1 << 18, 1024, 8 << 20
#: Bytes of ids that a worker holds before it passes them on.
HELD_BYTES = 4 << 20
#: Parts hold between these bytes of frames: as many parts as there are cores, unless they would be smaller or larger.
PART_BYTES = (4 << 20, 128 << 20)
#: Chunks whose ids a worker keeps, and the longest kept one; emptied when full, which costs time only.
KEPT_CHUNKS, KEPT_LENGTH = 400_000, 64
#: Stands between chunks that the library is asked for together. It is a token of its own, since digits are split off one by one.
BETWEEN = "0"

# letters, digits and signs on which every Unicode version agrees, without the capital whose small letter is two characters
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_PLAIN = re.compile(rf"[ -~\n\t\r{_LETTER}]*").fullmatch
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+").findall
#: Fixed value: how the tokenizer whose chunks are looked up one by one splits a text.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BLANK = re.compile("[\t\n\r]")
BLOCKS = ("part int, block int, dictionary string, first_doc long, last_doc long, start long, tokens long, "
          "doc_ids array<long>, counts array<long>, offsets array<long>, frames binary")


class ChunkIds:
    """Ids of texts as little-endian bytes, by the library, with those of a chunk between blanks looked up once.

    That is the same as whole texts if the tokenizer drops blanks: its splitter
    keeps matches alone, none of which holds a blank, and its normalizer changes
    characters one by one or together with combining marks, which a blank parts.
    Texts of plain letters, digits and signs are cut at the splitter's own matches,
    in small letters, so that fewer chunks are looked up; special strings are left
    to the library. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 65536 else "<u4")
        self.by_chunk = self._drops_blanks(json.loads(self.library.to_str()))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {"": b""}

    @staticmethod
    def _drops_blanks(model: dict) -> bool:
        steps = model["normalizer"] or {}
        split = ((model["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        marks = model["added_tokens"]
        return ([s["type"] for s in steps.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
                and steps["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and steps["normalizers"][1]["content"] == " "
                and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
                and split["pattern"] == {"Regex": SPLITTER}
                and not any(m["single_word"] or m["lstrip"] or m["rstrip"] or m["normalized"] or " " in m["content"] for m in marks))

    def _asked(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _together(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without BETWEEN in them, from one text in which it parts them."""
        mark = self._asked([BETWEEN])[0]
        ids = np.frombuffer(self._asked([f" {BETWEEN} ".join(chunks)])[0], self.type)
        ends = np.flatnonzero(ids == np.frombuffer(mark, self.type)[0]) if len(mark) == self.type.itemsize else ids
        if len(ends) != len(chunks) - 1:
            return self._asked(chunks)
        raw, wide = ids.tobytes(), self.type.itemsize
        begin, end = [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)]
        return [raw[b * wide:e * wide] for b, e in zip(begin, end)]

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self._asked(texts)
        parts = [_SPLIT(t.lower()) if _PLAIN(t) and not any(x in t for x in self.special) else _BLANK.sub(" ", t).split(" ") for t in texts]
        here = set().union(*parts)
        new = here.difference(self.chunks)
        if len(new) + len(self.chunks) > KEPT_CHUNKS:  # what these texts need again stays, and with it what is common
            self.chunks = {"": b""} | {w: self.chunks[w] for w in here.difference(new)}
        plain, other = sorted(w for w in new if BETWEEN not in w), sorted(w for w in new if BETWEEN in w)
        for k in range(0, len(plain), 1000):
            self.chunks.update(zip(plain[k:k + 1000], self._together(plain[k:k + 1000])))
        self.chunks.update(zip(other, self._asked(other)))
        out = [b"".join(map(self.chunks.__getitem__, words)) for words in parts]
        for w in new:
            if len(w) > KEPT_LENGTH:
                del self.chunks[w]
        return out


_OPEN: dict[str, ChunkIds] = {}


def opened(name_or_path: str) -> ChunkIds:
    if name_or_path not in _OPEN:
        _OPEN[name_or_path] = ChunkIds(name_or_path if "/" in name_or_path else tokenizer_path(name_or_path))
    return _OPEN[name_or_path]


def trained_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return raw if len(raw) >= 8 else b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _sampled(docs: DataFrame, tokenizer: str, end: int) -> bytes:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = docs.select(F.xxhash64(text, F.col("doc_id").cast("long")).alias("h"), F.substring(text, 1, SAMPLE_CHARS).alias("s"))
    # hashes are spread evenly: a limit on them leaves a little more than the sample, whose smallest are taken
    share = 1.2 * SAMPLE_DOCS / max(1, docs.count())
    near = hashed if share >= 1 else hashed.where(F.col("h") < int(2 ** 64 * share) - 2 ** 63)
    drawn = near.orderBy("h", "s").limit(SAMPLE_DOCS).collect()  # bounded by the two parameters
    tok = opened(tokenizer)
    close = np.array([end], tok.type).tobytes()
    return trained_dictionary([ids + close for ids in tok.batch([r["s"] for r in drawn])])


def _frames(docs: DataFrame, tokenizer: str, end: int, dictionary: bytes) -> DataFrame:
    """Rows doc_id, tie, row, tokens, bytes, frame; ``row`` tells equal rows apart and is fixed once written."""

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, row = opened(tokenizer), TaskContext.get().partitionId() << 40
        close = np.array([end], tok.type).tobytes()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                rows = batch.slice(k, 200)
                ids = [b + close for b in tok.batch([t or "" for t in rows.column(2).to_pylist()])]
                frames = [press.compress(b) for b in ids]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(range(row, row + len(ids)), pa.int64()),
                     pa.array([len(b) // tok.type.itemsize for b in ids], pa.int64()), pa.array([len(f) for f in frames], pa.int64()),
                     pa.array(frames, pa.binary())], names=["doc_id", "tie", "row", "tokens", "bytes", "frame"])
                row += len(ids)

    text = F.col("text").cast("string")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), text.alias("text"))
            .mapInArrow(compressed, "doc_id long, tie long, row long, tokens long, bytes long, frame binary"))


def _in_blocks(frames: DataFrame, dictionary: str) -> DataFrame:
    """Sorted frames of each partition, gathered into rows of BLOCKS."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        counts: list[int] = []
        held: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in held]))).tolist()
            known = [d for d in ids if d is not None]
            row = (part, number, dictionary, min(known, default=None), max(known, default=None), start, sum(counts), ids, counts, offsets, b"".join(held))
            kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=[f.split()[0] for f in BLOCKS.split(", ")])

        for batch in batches:
            for doc, n, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if held and (size + len(frame) > BLOCK_BYTES or len(held) == BLOCK_DOCS):
                    yield closed()
                    number, start, size, ids, counts, held = number + 1, start + sum(counts), 0, [], [], []
                ids.append(doc)
                counts.append(n)
                held.append(frame)
                size += len(frame)
        if held:
            yield closed()

    return frames.select("doc_id", "tokens", "frame").mapInArrow(blocks, BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int = END) -> None:
    """Write the token ids of all documents to the folder ``path``, which must not exist, in ascending doc_id order.

    A null text counts as empty and gives its closing id alone. Null doc_ids come
    first; rows of one doc_id stand by a hash of their text, and equal rows are
    documents like others, which a third of the table may be: they are spread
    over parts by a row number. Other columns are ignored. An empty table gives a
    data set without blocks.

    Texts are read once for the ids, and once for the sample of the dictionary.
    Only compressed frames are sorted, in parts of a size that follows from theirs.
    """
    spark = docs.sparkSession
    raw = _sampled(docs, tokenizer, end)
    frames = cut_lineage(_frames(docs, tokenizer, end, raw))
    total = frames.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_BYTES[1]), min(-(-total // PART_BYTES[0]), spark.sparkContext.defaultParallelism))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc(), F.col("row").asc()]
    sorted_frames = frames.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    head = [(digest(raw), bytearray(raw), tokenizer, end, opened(tokenizer).type.itemsize)]
    spark.createDataFrame(head, "sha256 string, dictionary binary, tokenizer string, end int, id_bytes int").coalesce(1).write.parquet(f"{path}/dictionary")
    # frames are compressed already; small row groups, since a group is in memory while it is written or read
    (_in_blocks(sorted_frames, digest(raw)).write.option("compression", "none").option("parquet.block.size", GROUP_BYTES)
     .option("parquet.page.size.row.check.min", 4).option("parquet.block.size.row.check.min", 4).parquet(f"{path}/blocks"))
    sums = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sums.select("part", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def _opened_set(spark: SparkSession, path: str) -> tuple[DataFrame, dict, bytes]:
    head = spark.read.parquet(f"{path}/dictionary").first().asDict()
    raw = bytes(head.pop("dictionary"))
    if digest(raw) != head["sha256"]:
        raise ValueError("the dictionary does not have its hash")
    place = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("part_start"))
    # a row a part: small enough for Spark to send it to the blocks, which it decides by the table's size
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(place, "part"), head, raw


def _decoded(blocks: DataFrame, head: dict, raw: bytes, wanted: frozenset[int] | None = None, digests: bool = False) -> DataFrame:
    """Documents of the blocks with their ids, or with the crc32 of these in their place."""
    kind, sha = np.dtype(f"<u{head['id_bytes']}"), head["sha256"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        rows: list[tuple] = []
        held = 0

        def passed() -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.int64() if digests else pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)],
                                              names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

        for batch in batches:
            for row in range(batch.num_rows):
                name, start, ids, counts, offsets = (batch.column(k)[row].as_py() for k in range(5))
                if name != sha:
                    raise ValueError("a block needs another dictionary than the one beside it")
                frames = memoryview(batch.column(5)[row].as_buffer())
                for k, (doc, n) in enumerate(zip(ids, counts)):
                    if wanted is None or doc in wanted:
                        wide = np.frombuffer(unpress.decompress(frames[offsets[k]:offsets[k + 1]]), kind).astype("<u4")
                        if len(wide) != n:
                            raise ValueError("a frame does not hold as many ids as its index says")
                        rows.append((doc, start, n, zlib.crc32(wide) if digests else wide.tobytes()))
                        held += 32 if digests else wide.nbytes
                        if held > HELD_BYTES:
                            yield passed()
                            rows, held = [], 0
                    start += n
        yield passed()

    return (blocks.select("dictionary", (F.col("start") + F.col("part_start")).alias("start"), "doc_ids", "counts", "offsets", "frames")
            .mapInArrow(documents, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digests else 'ids binary'}"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a data set: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    return _decoded(*_opened_set(spark, path))


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of ``read_tokens`` of a few documents: other blocks are skipped by their range, other frames by their offset."""
    blocks, head, raw = _opened_set(spark, path)
    low, high = F.col("first_doc"), F.col("last_doc")
    near = F.lit(False)
    for d in doc_ids:
        near = near | ((low <= F.lit(d)) & (high >= F.lit(d)))
    return _decoded(blocks.where(near), head, raw, frozenset(doc_ids))


def token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = END) -> DataFrame:
    """Write ``docs`` to a new data set in the shared folder, read it back, and return a digest of every document.

    Returns doc_id, start, n_tokens, ids_crc32. The odd cases are those of
    ``write_tokens``.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end)
    return _decoded(*_opened_set(spark, path), digests=True)
