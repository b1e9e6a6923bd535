"""Filter audit against plain filtering in every order."""

import re
from collections import defaultdict
from itertools import permutations

from helpers import no_docs, odd_docs, small

from barloom.llm import filter_audit as fa

WORDS = re.compile("[^\x20\x09-\x0d]+").findall
LABELS = "doc_id long, quality int, toxic int, note string"


def failing(text, doc_id, lowest):
    w = WORDS(text)
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > lowest[text]}


def brute(docs, labels):
    """Filters applied one after another to lists of documents, order by order."""
    lowest = {}
    for d, text, _ in docs:
        if d is not None:
            lowest[text or ""] = min(d, lowest.get(text or "", d))
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for d, text, source in docs:
        parts[source or ""].append((d, failing(text or "", d, lowest)))
    out, share = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                kept = [r for r in left if not r[1][f]]
                out[part, "".join(order), k + 1] = [
                    len(kept), len(gone), sum(r[1][f] for r in rows) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in rows),
                    sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone), f]
                share[part, f] += len(gone)
                left = kept
    return {k: (*v[:6], share[k[0], v[6]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_swaps_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), [tuple(range(n))]
        for k in fa.all_orders(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(permutations(range(n)))


def test_swapped_diagram_equals_a_fresh_one():
    counts = {m: (m * 7 % 5, m % 3, m % 2) for m in range(0, 32, 3)}
    d = fa.Diagram(counts, 5)
    for k in fa.all_orders(5):
        d.swap(k)
        renamed = {sum(1 << d.order.index(f) for f in range(5) if m >> f & 1): c for m, c in counts.items()}
        assert [s[1:] for s in d.steps()] == [s[1:] for s in fa.Diagram(renamed, 5).steps()]
    assert max(len(d.weight), 1) < 120 * 63


def test_audit_equals_plain_filtering(spark):
    docs = [r for r in odd_docs(spark).collect()]
    labels = [(1, 1, 0, "x"), (3, 1, 1, None), (3, 0, 0, None), (4, None, 1, None), (None, 1, 1, None), (6, 1, None, None), (99, 1, 1, None)]
    got = found(fa.filter_audit(odd_docs(spark), spark.createDataFrame(labels, LABELS)))
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs], [r[:3] for r in labels])
    assert {k[0] for k in got} == {"", "s"}


def test_conditions_at_their_limits(spark):
    word = [f"w{k}" for k in range(200)]
    texts = [" ".join(word), " ".join(word[:199]), "\x0b\x0c".join(word), " ".join(word[:100] * 2), " ".join(word[:99] * 2 + ["w0"] * 2), " ".join(word),
             "A" + "b" * 49, "A" + "b" * 48, "É" * 9, "a|b", "x" * 10, "", " \t\n ", " a  b\r\n", "漢字 Ünï 🎉 A"]
    docs = small(spark, texts + texts[:4], first=10)
    labels = spark.createDataFrame([], LABELS)
    assert found(fa.filter_audit(docs, labels)) == brute([(10 + k, t, "s") for k, t in enumerate(texts + texts[:4])], [])


def test_copies_across_parts_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "same", "a"), (3, "same", "b"), (3, "same", "c"), (4, None, None), (2, "", "")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(5, 1, 1, None)], LABELS)
    got = found(fa.filter_audit(docs, labels))
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [(5, 1, 1)])
    assert got["a", "EABCD", 1][:2] == (0, 1) and got["c", "EABCD", 1][:2] == (1, 0) and got["", "EABCD", 1][:2] == (1, 1)
    assert fa.filter_audit(no_docs(spark), labels).count() == 0
    assert fa.filter_audit(docs.drop("source"), labels).where("part <> ''").count() == 0
