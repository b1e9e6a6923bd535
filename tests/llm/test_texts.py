"""Decontamination, secrets, scores, quality and shards against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import SF, no_docs, odd_docs, small
from oracle import compare, connect

from barloom.llm import decontamination as dc, quality as ql, secrets as sc, sharding as sh, suffix_tree as st
from barloom.llm.common import read


def test_contamination_equals_sql(spark):
    ok, message = compare(dc.contamination(read(spark, SF, "documents"), read(spark, SF, "benchmark")), connect(SF), dc.SQL)
    assert ok, message


def words(text):
    return re.findall(dc.WORD, (text or "").translate(str.maketrans(dc.CAPITALS, dc.SMALL)))


def test_contamination_of_odd_items(spark):
    rng = random.Random(6)
    some = ["ab", "Cd", "é", "x1"]
    items = [(0, None), (1, ""), (2, "ab"), (3, "cd, AB"), (4, " ".join(rng.choice(some) for _ in range(10))), (4, "ab"), (5, " ".join(rng.choice(some) for _ in range(14))), (None, "x1 x1")]
    texts = [None, "", "zz", "AB", items[4][1] + " zz " + items[6][1].upper(), *(" ".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(30))]
    got = {r.doc_id: r for r in dc.contamination(small(spark, texts).withColumn("sh", dc.F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for k, t in enumerate(texts):
        w, hit, held = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for b in range(max(len(v) - 9, 1) if v else 0):
                win = v[b:b + 10]
                for a in range(len(w) - len(win) + 1):
                    if w[a:a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        held |= {item} - {None}
        ids = ",".join(sorted(map(str, held)))
        assert (got[k].n_words, got[k].n_hit, got[k].n_items, got[k].contaminated) == (len(w), len(hit), len(held), bool(hit))
        assert got[k].items_sha256 == hashlib.sha256(ids.encode()).hexdigest()


def test_contamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog by the old river")], "item_id long, text string")
    rows = dc.contamination(odd_docs(spark), items).collect()
    assert len(rows) == 14 and sorted(r.doc_id for r in rows if r.contaminated and r.doc_id) == [4, 4, 5, 7, 11]
    assert dc.contamination(odd_docs(spark), items.where("false")).where("contaminated").count() == 0
    assert dc.contamination(no_docs(spark), items).count() == 0
    left = dc.without_benchmark(odd_docs(spark), items)
    assert left.columns == odd_docs(spark).columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 6, 8, 9, 10]


BASE = (("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def test_base_spans():
    rng = random.Random(7)
    parts = ["password", "PassWD", "token", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "abcdef", "AKIA", "AKIA" + "A1" * 8, "0f" * 12, "0f" * 11, "é", "\n", "short", "x" * 7, "\t"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, fits) in enumerate(BASE) for m in p.finditer(text) if fits(m))
        assert sc.base_spans(text) == want


def test_secret_scan(spark):
    docs = read(spark, SF, "documents")
    scanner = sc.fit(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in sc.secret_scan(docs, scanner).collect():
        spans = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, fits) in enumerate(BASE) for m in p.finditer(texts[r.doc_id]) if fits(m))
        assert r.base_sha256 == hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("model")] == [s for *_, s in spans]


def test_network_adds_spans_that_look_like_findings(spark):
    rng = random.Random(8)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for k in range(400):
        secret = f'password = "{word(20, "0123456789abcdef")}"' if k % 2 else f"see http {word(6, 'ghijklmno')}.example-{rng.randint(1, 99)}.com/page{k}"
        texts.append("some text here " + secret + " and more words")
    texts.append("lonely value 9f3a77c1d05be84421ab in text")
    got = {r.doc_id: r for r in sc.secret_scan(small(spark, texts)).collect()}
    assert got[400].spans == "model:13:33" and got[400].n_model == 1 and got[400].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(got[k].n_model for k in range(0, 400, 2)) <= 8


def rare_findings(spark, n, every, last):
    """Texts of which every so many, beyond the first ``last`` by the hash of their id, hold a finding; the last one holds a lonely secret."""
    rng = random.Random(18)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    first = {r.id for r in spark.range(n).orderBy(sc.F.xxhash64("id"), "id").limit(last).collect()}
    texts = []
    for k in range(n):
        secret = f'password = "{word(20, "0123456789abcdef")}"' if k not in first and k % every == 0 else ""
        page = f"see http {word(6, 'ghijklmno')}.example-{rng.randint(1, 99)}.com/page{k}" if k % every == 1 else ""
        texts.append(f"some text here {secret}{page} and more words")
    texts[-1] = "lonely value 9f3a77c1d05be84421ab in text"
    return texts


def test_findings_outside_any_draw_are_learned_from(spark):
    texts = rare_findings(spark, 10_000, 5, 8_000)
    docs = small(spark, texts)
    assert {r.label for r in sc.findings(docs).select("label").distinct().collect()} == {True, False}
    got = {r.doc_id: r for r in sc.secret_scan(docs).where(f"doc_id = {len(texts) - 1} OR n_model > 0").collect()}
    assert got[len(texts) - 1].spans == "model:13:33"
    assert len(got) <= 200  # of 2,000 pages


def test_shards_learn_together(spark, monkeypatch):
    monkeypatch.setattr(sc, "SHARD", 200)
    docs = small(spark, rare_findings(spark, 1000, 2, 0))
    one, two = sc.fit(docs), sc.fit(docs.repartition(7))
    assert one.threshold == two.threshold <= 0.5 and np.array_equal(one.net.conv, two.net.conv)
    got = {r.doc_id: r for r in sc.secret_scan(docs, one).collect()}
    assert got[999].spans == "model:13:33" and sum(r.n_model for r in got.values()) <= 25


def test_secrets_of_odd_rows(spark):
    assert sc.secret_scan(odd_docs(spark)).count() == 14 and sc.secret_scan(no_docs(spark)).count() == 0
    long = "a1" * 5000
    assert sc.candidates(f"x {long} y-1") == [(2, 10002)] and len(sc.windows(f"x {long}", 2, 10002)) > 300


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(st, "HEAD", 200)  # most words meet their counts in the join
    docs = read(spark, SF, "documents").unionByName(small(spark, [None, "", "The THE x \x0b y"], 5000), allowMissingColumns=True)
    rows = {r.doc_id: r.text for r in docs.collect()}
    low = str.maketrans(dc.CAPITALS, dc.SMALL)
    tokens = {k: re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low)) + [None] for k, t in rows.items()}
    count = Counter(w for k, v in tokens.items() if zlib.crc32(str(k).encode()) % 10 for w in v)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in st.lm_scores(docs).collect()}
    for k, ws in tokens.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, zlib.crc32(str(k).encode()) % 10 == 0)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_tree_is_a_distribution_and_uses_the_longest_context():
    texts = [b"abracadabra " * 50, b"abba " * 40] * 5
    code, _ = st.codes(texts)
    rows = []
    for length in range(st.DEPTH + 1):
        rows.append(np.unique(code & ((1 << 8 * (length + 1)) - 1), return_counts=True))
    tree = st.retain(rows)
    assert len(tree.contexts[1]) and len(tree.contexts[3])
    for before in (b"abra", b"zzzz", b"ba"):
        every = np.array([int.from_bytes((bytes([st.START]) * st.DEPTH + before)[-st.DEPTH:] + bytes([s]), "big") for s in range(256)])
        assert math.isclose((10 ** tree.log10(every)).sum(), 1, rel_tol=1e-9)
    p = lambda before, s: 10 ** tree.log10(np.array([int.from_bytes((bytes([st.START]) * st.DEPTH + before)[-st.DEPTH:] + s, "big")]))[0]
    assert p(b"abrac", b"a") > 0.9 and p(b"abrac", b"b") < 0.05


def test_tables_score_as_the_tree_does():
    rng = random.Random(31)
    texts = ["".join(rng.choice("abcdé ") + rng.choice("ab") for _ in range(400)).encode() for _ in range(30)]
    code, _ = st.codes(texts)
    tree = st.retain([np.unique(code & ((1 << 8 * (length + 1)) - 1), return_counts=True) for length in range(st.DEPTH + 1)])
    asked, _ = st.codes(texts[:3] + [b"", b"never seen: XYZ\x00\xff", "abé漢".encode()])
    assert st._Table.fits(tree) and len(tree.contexts[2])
    assert st.scores_of(tree)(asked).tolist() == tree.log10(asked).tolist()


def test_texts_are_walked_without_their_codes(monkeypatch):
    rng = random.Random(19)
    texts = ["".join(rng.choice("abcé 漢") for _ in range(rng.randint(0, 200))).encode() for _ in range(60)] + [b""]
    code, _ = st.codes(texts)
    rows = [(np.unique(code & ((1 << 8 * (k + 1)) - 1), return_counts=True)) for k in range(st.DEPTH + 1)]
    tree = st.retain([(e, c.astype(np.int64)) for e, c in rows])
    asked = texts[:4] + [b"", b"never seen: XYZ\x00\xff", b""]
    code, begin = st.codes(asked)
    for of in (st._Scores(tree), st._Table(tree)):
        if isinstance(of, st._Table):
            monkeypatch.setattr(st, "codes", None)
        got, starts = of.of_texts(asked)
        assert got.tolist() == tree.log10(code).tolist() and starts.tolist() == begin.tolist()


def test_lm_scores_of_odd_rows(spark):
    assert st.lm_scores(odd_docs(spark)).count() == 14 and st.lm_scores(no_docs(spark)).count() == 0
    held = next(k for k in range(100) if st.held_out(k))
    r = st.lm_scores(small(spark, ["alone"], held)).collect()[0]  # nothing to learn from
    assert r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.score, 6 * math.log10(1 / 256))


def test_quality(spark):
    docs, labels = read(spark, SF.replace("0.01", "0.1"), "documents"), read(spark, SF.replace("0.01", "0.1"), "labels")
    rows = ql.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r.predicted for r in rows if r.quality == 0], [r.predicted for r in rows if r.quality == 1]
    assert len(bad) > 50 and sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.97 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_scores_equal_a_plain_network():
    """Every filter at every byte of every chunk, one after another."""
    net = ql.random_net(np.random.default_rng(4), 257, ql.EMBED, ql.WIDTH, ql.FILTERS, ql.HIDDEN)
    net.bias = np.random.default_rng(5).normal(0, .1, ql.FILTERS)
    net.a, net.b = 1.3, -0.2
    texts = [b"", b"x", "héllo wörld ".encode() * 40, bytes(range(256)) * 2, b"a" * 193]
    want = []
    for text in texts:
        logits = []
        for begin in range(0, max(1, len(text) - ql.OVERLAP), ql.CHUNK - ql.OVERLAP):
            codes = list(text[begin:begin + ql.CHUNK])
            codes += [256] * (ql.CHUNK - len(codes))
            peak = np.array([max(max(sum(net.embed[codes[p + k]] @ net.conv[k, :, f] for k in range(ql.WIDTH)) + net.bias[f]
                                     for p in range(ql.CHUNK - ql.WIDTH + 1)), 0) for f in range(ql.FILTERS)])
            logits.append(np.maximum(peak @ net.w1 + net.b1, 0) @ net.w2 + net.b2)
        want.append(1 / (1 + math.exp(-(net.a * np.mean(logits) + net.b))))
    got = ql.scores(net, texts, ql.pair_tables(net))
    np.testing.assert_allclose(got, want, rtol=1e-4)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 0, 0), (6, 0, 0), (8, 0, 1), (None, 1, 0), (5, None, 0), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    rows = ql.quality(odd_docs(spark), labels).collect()
    assert len(rows) == 14 and len({r.score for r in rows if r.doc_id in (1, 2, 10)}) == 1
    assert ql.quality(no_docs(spark), labels).count() == 0
    assert {r.score for r in ql.quality(odd_docs(spark), labels.where("false")).collect()} == {0.5}


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        text = bytes(k % 251 for k in range(n))
        rows = ql.chunks(text)
        whole = bytearray()
        for k, r in enumerate(rows):
            whole[k * (ql.CHUNK - ql.OVERLAP):] = bytes(x for x in r.tolist() if x < 256)
        assert bytes(whole) == text


def fewest(sizes, shards):
    """Smallest largest run, by dynamic programming."""
    best = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        best = [min([best[0]] if j == 0 else [max(best[i], sum(sizes[i:j])) for i in range(j + 1)]) for j in range(len(sizes) + 1)]
    return best[-1]


def test_minimax():
    rng = random.Random(9)
    for _ in range(200):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 18))]
        shards = rng.randint(1, 6)
        capacity, cuts = sh.minimax(sizes, shards)
        assert capacity == fewest(sizes, shards) and len(cuts) <= shards and cuts[-1] == len(sizes)


def test_even_cuts():
    rng = random.Random(10)
    for _ in range(300):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 30))]
        shards = rng.randint(1, 9)
        capacity, greedy = sh.minimax(sizes, shards)
        cuts = sh.even_cuts(sizes, shards, capacity)
        runs = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
        assert cuts[-1] == len(sizes) and len(greedy) <= len(cuts) <= shards and max(runs) <= capacity and min(runs) > 0
    sizes = [1] * 1000 + [1500] + [1] * 2000
    cuts = sh.even_cuts(sizes, 16, sh.minimax(sizes, 16)[0])
    runs = [sum(sizes[a:b]) for a, b in zip([0, *cuts], cuts)]
    assert len(runs) == 16 and max(runs) == 1500 and max(sorted(runs)[:-1]) < 1.35 * min(runs)


@pytest.mark.parametrize("bits", [(1, 1), (3, 2), (12, 8)])
def test_shards(spark, monkeypatch, bits):
    monkeypatch.setattr(sh, "FIRST_BITS", bits[0])
    monkeypatch.setattr(sh, "MORE_BITS", bits[1])
    docs = small(spark, ["t%d " % (k % 61) * (1 + k % 61 * (k % 7 == 0)) for k in range(400)] + ["hot"] * 150)
    rows = sh.shard(docs, 5).collect()
    groups = docs.select(sh.group_order(sh.F.col("text")).alias("o"), (sh.F.octet_length("text") + 1).alias("n")).groupBy("o").agg(sh.F.sum("n").alias("n")).orderBy("o").collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert max(size.values()) == sh.minimax([g.n for g in groups], 5)[0]
    text = {r.doc_id: r.text for r in docs.collect()}
    where = {}
    for r in rows:
        assert where.setdefault(text[r.doc_id], r["shard"]) == r["shard"] and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    for s in size:
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_shards_of_odd_rows(spark):
    rows = sh.shard(odd_docs(spark)).collect()
    assert len(rows) == 14 and all(r["size"] == 1 and r.text_crc32 == 0 for r in rows if r.doc_id in (1, 2, 10)) and {r.law for r in rows} == {"bytes"}
    assert sh.shard(no_docs(spark)).count() == 0
