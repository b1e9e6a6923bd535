"""Line dedup and near-duplicate join against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from helpers import SF, no_docs, odd_docs, small

from barloom.llm import jaccard_join as jj, line_dedup as ld
from barloom.llm.common import components, read


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def changed(rng, a, n, letters="abcd"):
    b = list(a)
    for _ in range(n):
        k, o = rng.randint(0, len(b)), rng.random()
        if o < .4:
            b.insert(k, rng.choice(letters))
        elif b and o < .7:
            b.pop(min(k, len(b) - 1))
        elif b:
            b[min(k, len(b) - 1)] = rng.choice(letters)
    return "".join(b)


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = changed(rng, a, rng.randint(0, 4), "abc")
        for most in (1, 2, 3):
            assert ld.within(a, b, most) == min(edits(a, b), most + 1)


@pytest.mark.parametrize("by_words", [True, False])
def test_segments_and_parities_lose_nothing(by_words):
    rng = random.Random(3)
    least = ld.WORDS if by_words else ld.PER_CHARACTER
    for _ in range(1500):
        a = [rng.choice("abcd") + (str(rng.randrange(9)) if by_words else "") for _ in range(rng.choice([least, 19, 20, 25, 39, 40, 41, 60, 61, 100, 159, 161, 200]))]
        a = a[:7] if by_words and len(a) < ld.WORDS else a
        b = list(a)
        for _ in range(ld.allowed(len(a), by_words)):
            k, o = rng.randrange(len(b)), rng.random()
            b[k:k + (o < .7)] = [rng.choice("abcdx")] if o < .4 or o >= .7 else []
        if min(len(a), len(b)) < least:
            continue
        x, y = (" ".join(a), " ".join(b)) if by_words else ("".join(a), "".join(b))
        if edits(a, b) > ld.allowed(min(len(a), len(b)), by_words):
            continue  # shrank below a step of the threshold
        line, key, own, tag = ld.keys_of(["zz", x, "some other line", y])
        mine, theirs = set(key[line == 1].tolist()), set(key[line == 3].tolist())
        assert set(key[(line == 1) & own].tolist()) & theirs or set(key[(line == 3) & own].tolist()) & mine
        u, v = int(tag[line == 1][0]), int(tag[line == 3][0])
        apart = ((u ^ v) & ((1 << ld.BITS) - 1)).bit_count()
        assert apart <= min(u >> ld.BITS, v >> ld.BITS) and ld.near(x, y)


def test_keys_do_not_depend_on_neighbours():
    lines = ["one two three four five six seven eight", "short", "a line of ten chars or more", "x" * 300, " ".join(map(str, range(500)))]
    line, key, own, tag = ld.keys_of(lines)
    for k, s in enumerate(lines):
        alone = ld.keys_of([s])
        assert key[line == k].tolist() == alone[1].tolist() and tag[line == k].tolist() == alone[3].tolist() and own[line == k].tolist() == alone[2].tolist()
    assert not (line == 1).any() and own[line == 4].sum() == ld.MOST + 1


def classes(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def plainly_near(a, b):
    """The rule of near lines, by the full table of edit distances."""
    x, y = a.split(), b.split()
    if (len(x) >= 8) != (len(y) >= 8):
        return False
    if len(x) >= 8:
        short = min(len(x), len(y))
        most = min(8, max(1, short // 20))
    else:
        x, y, short = a, b, min(len(a), len(b))
        most = min(2, short // 10)
    if not most or abs(len(x) - len(y)) > most or sum((Counter(x) - Counter(y)).values()) > most:
        return False
    return edits(x, y) <= most


def expected_drops(docs):
    """{doc_id: drops} by comparing all lines with all lines."""
    rows = sorted(((d, t) for d, t in docs), key=lambda r: r[0])
    lines = [(d, k, s) for d, t in rows for k, s in enumerate((t or "").split("\n")) if s.strip()]
    distinct = list(dict.fromkeys(s for *_, s in lines))
    at = {s: k for k, s in enumerate(distinct)}
    # only lines of almost one length can be near; words come before characters
    size = sorted(range(len(distinct)), key=lambda k: (len(distinct[k].split()) < 8, len(distinct[k].split()) if len(distinct[k].split()) >= 8 else len(distinct[k])))
    measure = [(len(distinct[k].split()) if len(distinct[k].split()) >= 8 else -len(distinct[k])) for k in size]
    close = []
    for i, a in enumerate(size):
        for j in range(i + 1, len(size)):
            if abs(abs(measure[j]) - abs(measure[i])) > 8 or (measure[i] > 0) != (measure[j] > 0):
                break
            if plainly_near(distinct[a], distinct[size[j]]):
                close.append((a, size[j]))
    root = classes(len(distinct), close)
    first, out = {}, {}
    for d, k, s in lines:
        c = root[at[s]]
        if c in first:
            out.setdefault(d, []).append(f"{k}={first[c]}")
        else:
            first[c] = f"{d}:{k}"
    return {d: ",".join(v) for d, v in out.items()}


def test_line_dedup(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(18, 60))) for _ in range(40)]
    docs = [(k, "\n".join(changed(rng, rng.choice(base), rng.randint(0, 3), "abcdefgh ") for _ in range(rng.randint(0, 6)))) for k in range(80)]
    got = {r.doc_id: r for r in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = expected_drops(docs)
    assert want and {d: r.drops for d, r in got.items() if r.drops} == want
    for d, t in docs:
        gone = {int(x.split("=")[0]) for x in want.get(d, "").split(",") if x}
        assert got[d].text == "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone)


def test_line_dedup_of_words(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 3)
    monkeypatch.setattr(ld, "HOT_COPIES", 5)
    rng = random.Random(14)
    vocabulary = ["w%d" % k for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([7, 8, 9, 19, 20, 39, 40, 45, 61, 170]))] for _ in range(25)]
    docs = []
    for k in range(120):
        out = []
        for _ in range(rng.randint(0, 5)):
            w = list(base[0] if rng.random() < .3 else rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                j, o = rng.randrange(len(w)), rng.random()
                w[j:j + (o < .8)] = [rng.choice(vocabulary)] if o < .6 or o >= .8 else []
            out.append(" ".join(w))
        docs.append((k, "\n".join([*out, "", "Home"])))
    got = {r.doc_id: r.drops for r in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.drops}
    want = expected_drops(docs)
    assert got == want and any(len(v.split(",")) > 3 for v in want.values())


def test_keys_met_by_several_lines_pass_in_any_batches():
    rng = random.Random(16)
    for _ in range(300):
        rows = [(rng.randrange(6), rng.randrange(4), rng.random() < .4, 0) for _ in range(rng.randint(0, 40))]
        rows.sort(key=lambda r: (r[0], not r[2], r[1]))
        shared, got, at = ld._Shared(), [], 0
        while at < len(rows):
            n = rng.randint(1, 7)
            cols = list(zip(*rows[at:at + n]))
            got += zip(*(c.tolist() for c in shared.rows(*(np.array(c, t) for c, t in zip(cols, (np.int64, np.int64, bool, np.int64))))))
            at += n
        for key in range(6):
            lines = {(x, o) for k, x, o, _ in rows if k == key}
            met = any(o for _, o in lines) and len({x for x, _ in lines}) > 1
            assert {x for k, x, _, _ in got if k == key} == ({x for x, _ in lines} if met else set()), (rows, got)


def test_keys_met_by_lines_in_any_order():
    rng = random.Random(17)
    for _ in range(300):
        rows = [(rng.randrange(6), rng.randrange(4), rng.random() < .4, 0) for _ in range(rng.randint(0, 40))]
        rows.sort(key=lambda r: (r[0], not r[2]))  # lines as they come
        for step in (40, 3):
            shared, got = ld._Shared(), []
            for at in range(0, len(rows), step):
                cols = list(zip(*rows[at:at + step]))
                got += zip(*(c.tolist() for c in shared.rows(*(np.array(c, t) for c, t in zip(cols, (np.int64, np.int64, bool, np.int64))))))
            for key in range(6):
                lines = {(x, o) for k, x, o, _ in rows if k == key}
                met = any(o for _, o in lines) and len({x for x, _ in lines}) > 1
                found = [(x, o) for k, x, o, _ in got if k == key]
                assert {x for x, _ in found} == ({x for x, _ in lines} if met else set()), (rows, got)
                assert step < 40 or len(found) == len({x for x, _ in found})
                assert {x for x, o in found if o} == ({x for x, o in lines if o} if met else set())


def test_words_of_lines_are_those_of_split(monkeypatch):
    rng = random.Random(18)
    space = [chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) != "\n"]
    for at_once in (1 << 20, 7):
        monkeypatch.setattr(ld, "AT_ONCE", at_once)
        hashes = {}
        for _ in range(40):
            lines = ["".join(rng.choice(["a", "b", "é", "漢", "🎉", "\ud800", "\u200b", rng.choice(space)]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 9))]
            many, value = ld._words(lines)
            words = [w for s in lines for w in s.split()]
            assert many.tolist() == [len(s.split()) for s in lines]
            for w, h in zip(words, value.tolist(), strict=True):
                assert hashes.setdefault(w, h) == h
        assert len(set(hashes.values())) == len(hashes) > 200


def test_line_dedup_of_documents(spark):
    docs = read(spark, SF, "documents").where("doc_id < 400")  # a fixture: every pair is compared
    got = {r.doc_id: r.drops for r in ld.line_dedup(docs).collect() if r.drops}
    assert got == expected_drops([(r.doc_id, r.text) for r in docs.collect()])


def test_a_class_under_a_shared_segment(spark):
    """Near copies of one line, and other lines that share a segment with them but are near only each other."""
    rng = random.Random(15)
    head = "alpha beta gamma delta"
    near = [f"{head} epsilon zeta eta theta iota w{k}" for k in range(150)]
    pairs = [f"{head} {' '.join(rng.choice('abcdefgh') * 3 + str(rng.randrange(99)) for _ in range(6))}" for _ in range(20)]
    others = [p + tail for p in pairs for tail in ("", " end")]
    docs = [(k, s) for k, s in enumerate(near + others)]
    got = {r.doc_id: r.drops for r in ld.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.drops}
    assert got == expected_drops(docs) and len(got) == 149 + 20


def test_line_dedup_of_odd_rows(spark):
    rows = ld.line_dedup(odd_docs(spark)).collect()
    assert len(rows) == 14
    of = {r.doc_id: r for r in rows if r.doc_id}
    assert of[1].text is None and of[1].n_lines == 0 and of[2].n_lines == 1 and of[4].n_dropped == 0 and of[5].drops == "0=4:0"
    assert of[7].drops == "0=4:0" and of[11].drops == "0=4:0,1=4:0" and of[11].text == "short"  # one word of fifteen differs
    assert ld.line_dedup(no_docs(spark)).count() == 0
    left = ld.without_repeats(odd_docs(spark))
    assert left.columns == odd_docs(spark).columns and 5 not in [r.doc_id for r in left.collect()] and left.where("doc_id = 4").count() == 2


def brute_links(texts):
    sets = [set(jj.shingles(t).tolist()) for t in texts]
    return [(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]


def test_jaccard_join(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 20)  # several blocks in a group
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    texts = []
    for k in range(160):
        w = list(base[0] if k % 2 else rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    links = brute_links(texts)
    root, degree = classes(len(texts), links), [0] * len(texts)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r.doc_id: r for r in jj.jaccard_join(small(spark, texts)).collect()}
    assert [got[k].class_id for k in range(len(texts))] == root
    assert [got[k].n_links for k in range(len(texts))] == degree
    kept = jj.one_of_each(small(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_pruning_keeps_true_pairs():
    assert jj.least_agreements(16) < 0.8 * 16 < 16 and jj.least_agreements(128) < 0.8 * 128
    sizes = [jj.least_agreements(n) for n in range(16, 129, 16)]
    assert sizes == sorted(sizes)


def test_jaccard_join_of_odd_rows(spark):
    rows = jj.jaccard_join(odd_docs(spark)).collect()
    assert len(rows) == 14
    of = {r.doc_id: r for r in rows if r.doc_id}
    assert of[5].class_id == 4 and of[4].n_links == 3 and of[10].class_id == 1
    assert jj.jaccard_join(no_docs(spark)).count() == 0
    kept = jj.one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8, 9, 11]
    assert jj.one_of_each(no_docs(spark)).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (9, 8)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)]])
def test_components(spark, links):
    got = {r.node: r.root for r in components(spark.createDataFrame([(v, u) for u, v in links], "u long, v long")).collect()}
    nodes = sorted({x for e in links for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    root = classes(len(nodes), [(at[a], at[b]) for a, b in links])
    assert got == {x: nodes[root[at[x]]] for x in nodes}


def test_join_of_documents_with_itself(spark):
    docs = read(spark, SF, "documents").where("doc_id < 300")  # a fixture: every pair is compared
    rows = docs.orderBy("doc_id").collect()
    root = classes(len(rows), brute_links([r.text for r in rows]))
    got = {r.doc_id: r.class_id for r in jj.jaccard_join(docs).collect()}
    assert [got[r.doc_id] for r in rows] == [rows[k].doc_id for k in root]
