"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import corpus_pipeline as cp
from helpers import SF, no_docs, odd_docs
from test_lines import brute_links, classes, expected_drops
from test_texts import words

from barloom.llm import quality as ql
from barloom.llm.common import read, stored


def test_stages(spark):
    docs = stored(read(spark, SF, "documents").where("doc_id < 250"))  # a fixture: every pair is compared
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_duplicates", "benchmark", "packing"]
    kept = stored(cp.STAGES[0][1](spark, docs, SF))
    scores = {r.doc_id: r.score for r in ql.quality(docs, read(spark, SF, "labels")).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, s in scores.items() if s >= 0.3)

    before = kept.collect()
    lined = stored(cp.STAGES[1][1](spark, kept, SF))
    drops = expected_drops([(r.doc_id, r.text) for r in before])
    want = {}
    for r in before:
        gone = {int(x.split("=")[0]) for x in drops.get(r.doc_id, "").split(",") if x}
        text = "\n".join(s for k, s in enumerate(r.text.split("\n")) if k not in gone)
        if text.strip() or not gone:
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in lined.collect()} == want and all(r.n_chars == len(r.text) for r in lined.collect())

    before = lined.orderBy("doc_id").collect()
    single = stored(cp.STAGES[2][1](spark, lined, SF))
    root = classes(len(before), brute_links([r.text for r in before]))
    assert sorted(r.doc_id for r in single.collect()) == sorted({before[k].doc_id for k in root})

    before = single.collect()
    clean = stored(cp.STAGES[3][1](spark, single, SF))
    windows = {" ".join(w[b:b + 10]) for w in (words(r.text) for r in read(spark, SF, "benchmark").collect()) for b in range(max(len(w) - 9, 1) if w else 0)}
    dirty = {r.doc_id for r in before if any(f" {w} " in f" {' '.join(words(r.text))} " for w in windows)}
    assert sorted(r.doc_id for r in clean.collect()) == sorted({r.doc_id for r in before} - dirty)
    assert all(df.columns == columns for df in (kept, lined, single, clean))

    pieces = cp.STAGES[4][1](spark, clean, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in clean.collect()}


def test_empty_table(spark):
    docs = no_docs(spark)
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and clashing columns pass through; what leaves a stage was in it."""
    docs = odd = stored(odd_docs(spark))
    for name, stage in cp.STAGES[:-1]:
        kept = stored(stage(spark, docs, SF))
        assert kept.columns == odd.columns, name
        before, after = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in kept.collect())
        assert not after - before, name
        docs = kept
    pieces = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}
    # a stage on its own input: texts without words are no copies of others' lines and hold no benchmark window
    lined = {r.doc_id: r.text for r in cp.STAGES[1][1](spark, odd, SF).collect()}
    assert lined[1] is None and lined[2] == "" and lined[3] == "  \n\n " and 5 not in lined and lined[11] == "short"
    assert cp.STAGES[3][1](spark, odd, SF).count() == odd.count()
