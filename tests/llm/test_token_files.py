"""Token files: an exact round trip against the tokenizer library."""

import random
import uuid
import zlib

import numpy as np
import pytest
from helpers import SF, no_docs, odd_docs, small

from barloom.llm import token_files as tf
from barloom.llm.common import read, tokenizer_path
from barloom.session import shared_folder

PARTS = ["  ", " ", "\n", "a", "The", " the", "ß", "É", "é", "́", "漢", "🎉", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "ς", "1", "23", "\t", "\x0b",
         "\x1c", " ", "　", "x's", "'LL", "==", "----", "\r\n", "가", "ing", "function", "    ", "é", "ͅ", "‍"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_chunks_equal_the_library(library):
    tok, rng = tf.ChunkIds(tokenizer_path("word_bpe_49k.json")), random.Random(2)
    assert tok.by_chunk
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + ["x" * 3000]
    for t, ids in zip(texts, tok.batch(texts)):
        assert np.frombuffer(ids, tok.type).tolist() == library.encode(t, add_special_tokens=False).ids
    assert not tf.ChunkIds(tokenizer_path("byte_bpe_50k.json")).by_chunk
    assert all(len(w) <= tf.KEPT_LENGTH for w in tok.chunks)


def expected(rows, library):
    """Documents by id, nulls first; the order within one id is left open."""
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_documents_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(tf, "PART_BYTES", (1 << 15, 1 << 17))
    docs = read(spark, SF, "documents")
    got = sorted(tuple(r) for r in tf.token_files(docs).collect())
    assert got == sorted(expected([(r.doc_id, r.text) for r in docs.collect()], library))


def test_odd_rows(spark, library):
    got = sorted((tuple(r) for r in tf.token_files(odd_docs(spark)).collect()), key=lambda r: r[1])
    want = expected([(r.doc_id, r.text) for r in odd_docs(spark).collect()], library)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((r[0] or 0, *r[2:]) for r in got) == sorted((r[0] or 0, *r[2:]) for r in want)
    assert all(b[1] == a[1] + a[2] for a, b in zip(got, got[1:])) and got[0][1] == 0
    assert tf.token_files(no_docs(spark)).count() == 0


def test_one_document_is_found_by_its_index(spark, library, monkeypatch):
    monkeypatch.setattr(tf, "BLOCK_DOCS", 3)
    docs = small(spark, [f"document number {k} says {'so ' * k}" for k in range(40)])
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tf.write_tokens(docs, path)
    want = {r[0]: r for r in expected([(r.doc_id, r.text) for r in docs.collect()], library)}
    got = tf.find_documents(spark, path, [7, 31, 99]).collect()
    assert {(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got} == {want[7], want[31]}
    blocks = spark.read.parquet(f"{path}/blocks").orderBy("part", "block").collect()
    assert [d for b in blocks for d in b.doc_ids] == list(range(40)) and max(len(b.doc_ids) for b in blocks) == 3
    assert all(len(b.offsets) == len(b.doc_ids) + 1 and b.offsets[-1] == len(b.frames) for b in blocks)


def test_a_block_of_another_dictionary_is_refused(spark):
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tf.write_tokens(small(spark, ["one", "two"]), path)
    spark.createDataFrame([("0" * 64, bytearray(b"other"), "word_bpe_49k.json", 2, 2)],
                          "sha256 string, dictionary binary, tokenizer string, end int, id_bytes int").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        tf.read_tokens(spark, path)
    raw = b"another dictionary"
    spark.createDataFrame([(tf.digest(raw), bytearray(raw), "word_bpe_49k.json", 2, 2)],
                          "sha256 string, dictionary binary, tokenizer string, end int, id_bytes int").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        tf.read_tokens(spark, path).collect()


def test_dictionary_helps_short_documents(library):
    docs = [(" ".join(random.Random(k).choices(["alpha", "beta", "gamma", "delta", "the", "of", "and"], k=40))) for k in range(400)]
    ids = tf.opened("word_bpe_49k.json").batch(docs)
    import zstandard
    raw = tf.trained_dictionary(ids[:300])
    small_frames = sum(len(zstandard.ZstdCompressor(level=3, dict_data=tf._dictionary(raw)).compress(b)) for b in ids[300:])
    assert small_frames < 0.8 * sum(len(zstandard.ZstdCompressor(level=3).compress(b)) for b in ids[300:])
    assert tf.trained_dictionary([]) == b"" and tf.trained_dictionary([b"12345678"]) == b"12345678"
