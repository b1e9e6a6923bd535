"""Runs by grammar against a search of every period at every place."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from helpers import SF, no_docs, odd_docs, small

from barloom.llm import periodic_runs as pr
from barloom.llm.common import read


def brute(words):
    """(start, length, period) of all runs: stretches of every period, the ones with a smaller period left out."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if end > at and length >= max(6, 4 * q):
                part = words[at:at + length]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((at, length, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    letters = rng.choice([1, 2, 2, 3, 5, 30])
    words = [rng.randrange(letters) for _ in range(rng.randint(0, 120))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 11))]
        at = rng.randint(0, len(words))
        words[at:at] = (unit * 9)[:rng.randint(1, len(unit) * 9)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        docs = [made(rng) for _ in range(rng.randint(1, 10))]
        docs += docs[:rng.randint(0, 2)]  # copies share all their symbols
        for words, got in zip(docs, pr.runs_of([np.array(d, np.int64) for d in docs])):
            assert [tuple(r) for r in got.tolist()] == brute(words)


def test_grammar_derives_the_text_and_no_pair_is_left_twice():
    rng = np.random.default_rng(3)
    for text in (rng.integers(0, 4, 500), np.zeros(300, np.int64), np.tile(rng.integers(0, 50, 60), 5), np.zeros(0, np.int64)):
        whole = np.append(text, 60)
        g = pr.re_pair(whole, 61, 1)

        def derived(s):
            return [int(s)] if s < g.base else derived(g.left[s - g.base]) + derived(g.right[s - g.base])

        assert [w for s in g.top for w in derived(s)] == whole.tolist()
        assert all(derived(g.base + k) == whole[a:a + n].tolist() for k, (a, n) in enumerate(zip(g.at, g.size)))
        pairs = {}
        for k, pair in enumerate(zip(g.top[:-1].tolist(), g.top[1:].tolist())):
            if pair in pairs:
                assert pair[0] == pair[1] and k - pairs[pair] == 1  # only as an overlap with itself
            pairs[pair] = k


def test_pieces_of_a_run_are_joined():
    got = pr.merged(np.array([[0, 10, 2], [4, 20, 2], [19, 30, 2], [0, 40, 3], [28, 50, 2], [100, 110, 1]]))
    assert got.tolist() == [[0, 20, 2], [0, 40, 3], [19, 50, 2], [100, 110, 1]]


def expected(doc_id, text, planted):
    words = pr._WORDS(text or "")
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    s, n, q = best[0] if best else (None, None, None)
    return (doc_id, len(runs), s, n, q, 1000 * n // q if best else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_documents_equal_brute_force(spark):
    docs = read(spark, SF, "documents").where("length(text) < 6000")  # a fixture: the search is quadratic
    want = sorted(expected(r.doc_id, r.text, True) for r in docs.collect())
    got = sorted(tuple(r) for r in pr.periodic_runs(docs, planted=True).collect())
    assert got == want and sum(r[1] > 0 for r in got) > 20


def test_odd_rows(spark):
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    rows = [r for r in odd_docs(spark).collect() if r.doc_id != 6]
    got = [tuple(r) for r in pr.periodic_runs(odd_docs(spark)).collect()]
    assert sorted((r for r in got if r[0] != 6), key=key) == sorted((expected(r.doc_id, r.text, False) for r in rows), key=key)
    assert [r[1:6] for r in got if r[0] == 6] == [(1, 0, 60_000, 1, 60_000_000)]
    assert pr.periodic_runs(no_docs(spark)).count() == 0 and pr.find_runs(no_docs(spark)).count() == 0


def test_listed_runs(spark):
    docs = small(spark, ["x a b a b a b a b y", "z z z z z z", "z z z z z", None, "a b " * 6])
    assert sorted(tuple(r) for r in pr.find_runs(docs).collect()) == [(0, 1, 8, 2, "a b"), (1, 0, 6, 1, "z"), (4, 0, 6, 1, "a b")]
