import math

import numpy as np
import pytest

from textloom.llm import mtree


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in ok if i % 10 == 0}.items():
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("tree", [4096, 40])
def test_top_k(spark, monkeypatch, tree):
    monkeypatch.setattr(mtree, "TREE", tree)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * 0.2).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # ties and copies
    rows += [(400, None), (401, [None] * 8), (402, [math.nan] * 8), (403, [math.inf] + [0.0] * 7), (404, [1.0, 2.0]), (405, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = mtree.top_k(df, df.where("vec_id % 10 = 0"), k=7)
    assert {tuple(r) for r in got.collect()} == brute(rows, 7)


def test_few_and_none(spark):
    df = spark.createDataFrame([(10, [1.0]), (11, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in mtree.top_k(df, df.where("vec_id = 10")).collect()] == [(10, 1, 11, 1024 * 2048)]
    assert mtree.top_k(df.limit(0), df.limit(0)).count() == 0


def test_search_skips_most_distances():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(40, 16)) * 50
    x = np.floor(np.repeat(centers, 100, axis=0) + rng.normal(size=(4000, 16))).astype(np.int64)
    tree = mtree.MTree(np.arange(4000), x, float((x.astype(float) ** 2).sum(axis=1).max()))
    want = sorted((-int(s), i) for i, s in enumerate(x @ x[0]) if i)[:10]
    assert sorted((-s, i) for s, i in tree.search(0, x[0], 10, None)) == want
