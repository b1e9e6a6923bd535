"""Nearest neighbours against brute force."""

import numpy as np
from helpers import SF

from barloom.llm import nearest as nn
from barloom.llm.common import read


def brute(ids, x, own, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u[ids.index(own)]
    return [(ids[j], s[j]) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != own][:k]


def test_recall(spark):
    t = read(spark, SF, "embeddings").toPandas()
    ids, x = t.vec_id.tolist(), np.stack(t.embedding.to_numpy()).astype(float)
    got = nn.nearest(read(spark, SF, "embeddings")).toPandas()
    hits = wanted = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and q not in g.vec_id.tolist()
        assert g.score.is_monotonic_decreasing
        want = brute(ids, x, q)
        truth = dict(zip(ids, (x / np.linalg.norm(x, axis=1)[:, None]) @ (x[ids.index(q)] / np.linalg.norm(x[ids.index(q)]))))
        assert all(abs(truth[v] - s) < 1e-9 for v, s in zip(g.vec_id, g.score))
        hits += len({v for v, _ in want} & set(g.vec_id))
        wanted += len(want)
    assert got.query_id.nunique() == sum(i % 50 == 0 for i in ids) and hits >= 0.9 * wanted


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (100, [])]
    df = spark.createDataFrame([(i, v, 9, 0.5) for i, v in rows], "vec_id long, embedding array<float>, block int, score double")
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 6)) for r in nn.nearest(df).collect()}
    h = round(2 ** -0.5, 6)
    assert got == {(0, 1): (1, h), (0, 2): (2, h), (0, 3): (50, 0.0), (50, 1): (1, h), (50, 2): (2, h), (50, 3): (0, 0.0)}
    assert nn.nearest(df.where("false")).count() == 0


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK", 100)
    monkeypatch.setattr(nn, "QUERIES", 3)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype("float32")
    got = nn.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {v for v, _ in brute(list(range(600)), x.astype(float), q)}) for q in range(0, 600, 50))
    assert len(got) == 60 and hits >= 54
