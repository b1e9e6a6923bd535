"""Prefix token counts and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import pytest
from helpers import SF, no_docs, odd_docs, small

from barloom.llm import packing as pk
from barloom.llm.common import read
from barloom.llm.token_counts import prefix_counts, prefix_table, token_counts

PARTS = ["  ", " ", "\n", "a", "the", " the", "ß", "é", "漢", "🎉", "<s>", "</s>", "<0x0A>", "▁", "▁▁", "1", "23", "\t", "x", "==", "----", "\r\n", " ", "ing", "function", "    ", "é"]


def test_every_prefix_equals_the_library():
    table, rng = prefix_table("piece_bpe_32k.model"), random.Random(1)
    for _ in range(400):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        want = [len(table.library.encode(s[:i])) for i in range(len(s) + 1)]
        assert table.prefixes(s) == want
        assert table.counts([s]) == [want[-1]]
        for budget in (0, 1, 3, 6):
            assert table.fit(s, budget) == max(i for i, c in enumerate(want) if c <= budget)


def test_counts_of_documents(spark):
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r for r in token_counts(docs).collect()}
    lib = prefix_table("piece_bpe_32k.model").library
    for r in docs.select("doc_id", "text").collect():
        n = len(lib.encode(r.text))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 4096)
        if n > 4096:
            fit = got[r.doc_id].fit_chars
            assert len(lib.encode(r.text[:fit])) <= 4096 < len(lib.encode(r.text[:fit + 1]))


def test_counts_of_odd_rows(spark):
    rows = token_counts(odd_docs(spark)).collect()
    assert len(rows) == 14 and sum(r.doc_id == 4 for r in rows) == 2
    lib = prefix_table("piece_bpe_32k.model").library
    texts = {r.doc_id: r.text for r in odd_docs(spark).collect() if r.doc_id}
    assert all(r.n_tokens == len(lib.encode(texts[r.doc_id] or "")) for r in rows if r.doc_id)
    assert token_counts(no_docs(spark)).count() == 0
    assert prefix_counts(small(spark, ["ab", None])).orderBy("doc_id").collect()[1].counts == [0]


def test_ids_equal_the_library():
    tok, rng = pk.Ids(pk.tokenizer_path("byte_bpe_50k.json")), random.Random(3)
    texts = ["".join(rng.choice(PARTS + ["'s", " 'll", "\n\n", " \n", "É", "1 000"]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    for t, ids in zip(texts, tok.batch(texts)):
        assert np.frombuffer(ids, tok.type).tolist() == tok.library.encode(t, add_special_tokens=False).ids


def test_packing_joins_totals_that_are_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(pk, "SENT_ROWS", -1)
    docs = read(spark, SF, "documents").where("doc_id < 100")
    check_pieces(docs, pk.pack(docs).collect())


def check_pieces(docs, pieces, sequence=1024):
    tok = pk.opened("byte_bpe_50k.json").library
    from collections import Counter, defaultdict
    ids = Counter()
    for r in docs.collect():
        ids[r.doc_id, tuple(tok.encode(r.text or "", add_special_tokens=False).ids + [0])] += 1
    tokens, at = 0, defaultdict(list)
    for p in pieces:
        at[p.sequence_id].append((p.offset, p.length))
        tokens += p.length
    last = max(at, default=0)
    for k, runs in at.items():
        runs.sort()
        assert [o for o, _ in runs] == np.r_[0, np.cumsum([n for _, n in runs])[:-1]].tolist()
        assert sum(n for _, n in runs) == sequence or k == last
    assert sorted(at) == list(range(last + 1 if at else 0))
    assert tokens == sum(len(i) * n for (_, i), n in ids.items())
    left = Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
    one = {d: i for (d, i), n in ids.items() if n == 1 and sum(e == d for e, _ in ids) == 1}
    for (d, start, n, crc, size), _ in left.items():
        if d in one:
            assert size == len(one[d]) and crc == zlib.crc32(np.array(one[d][start:start + n], "<u4").tobytes())


def test_packing(spark):
    docs = read(spark, SF, "documents")
    pieces = pk.pack(docs).collect()
    check_pieces(docs, pieces)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    total = sum(p.length for p in pieces)
    share = {}
    for p in pieces:
        share[source[p.doc_id]] = share.get(source[p.doc_id], 0) + p.length
    windows = total // (1024 * pk.WINDOW)
    for s in share:  # every full window holds each source's share to within a token
        for w in range(windows):
            got = sum(p.length for p in pieces if source[p.doc_id] == s and p.sequence_id // pk.WINDOW == w)
            assert abs(got - share[s] / total * 1024 * pk.WINDOW) < 2


def test_packing_with_targets(spark):
    docs = small(spark, ["a b c d " * 200, "e f g " * 100, "h i " * 300]).withColumn("source", pk.F.concat(pk.F.lit("s"), "doc_id"))
    pieces = pk.pack(docs, sequence=64, window=4, targets={"s0": 3.0, "s1": 1.0, "s2": 1.0}).collect()
    check_pieces(docs, pieces, 64)
    first = [p for p in pieces if p.sequence_id < 4]
    assert abs(sum(p.length for p in first if p.doc_id == 0) - 0.6 * 256) < 2
    with pytest.raises(ValueError, match="every source"):
        pk.pack(docs, targets={"s0": 1.0})


def test_packing_of_odd_rows(spark):
    check_pieces(odd_docs(spark), pk.pack(odd_docs(spark)).collect())
    assert pk.pack(no_docs(spark)).count() == 0
    assert pk.pack(small(spark, [None]).drop("source")).collect()[0].length == 1
