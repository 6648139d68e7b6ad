import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import minhash as M
from textloom.llm import near_dedup
from textloom.llm.exact_dedup import exact_dedup, exact_groups
from textloom.llm.near_dedup import near_dedup as near_rows
from textloom.llm.near_dedup import near_groups

DOCS = "doc_id long, text string"


def brute_near(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, n=240):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one two")]
    bases = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 20, 60, 150]))] for _ in range(12)]
    for i in range(10, 10 + n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "percent", "block"), [(1, 85, 128), (2, 80, 128), (3, 85, 4)])
def test_near_groups_match_brute_force(spark, monkeypatch, seed, percent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus(seed)
    got = near_groups(spark.createDataFrame(rows, DOCS).repartition(3), percent=percent).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_near(rows, percent)


def test_block_comparison_alone_finds_what_stars_miss():
    rows = corpus(7)
    want = brute_near(rows, 85)
    sets = {i: M.shingles(t, M.WordHashes()) for i, t in rows}
    low = {i: np.unique((s >> np.uint64(32)).astype(np.uint32)) for i, s in sets.items() if len(s)}
    got = near_dedup._block_links([(2, i, i, len(sets[i]), s) for i, s in low.items()], 85)
    linked = defaultdict(set)
    for a, b in got:
        if M.similar(sets[a], sets[b], 85):
            linked[want[a][1]].add((a, b))
            assert want[a][1] == want[b][1]
    for root in {c for i, (n, c, _) in want.items() if n}:
        group = [i for i, (_, c, _) in want.items() if c == root]
        assert len(group) == 1 or linked[root]


def test_near_groups_edges(spark):
    assert near_groups(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, "A B C D E F", None)]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string, component_id string"))
    assert {(r.doc_id, r.component_id, r.kept) for r in got.collect()} == {(5, 3, False), (3, 3, True), (None, None, False)}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (20, 200, 5000):
        errors = []
        for _ in range(30):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate((a[: int(n * 0.9)], rng.integers(0, 2**63, n // 10, dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((M.signature(a) == M.signature(b)).mean() - true)
        assert abs(np.mean(errors)) < 0.05


def test_exact_groups(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "Äb"), (4, "äb"), (5, None), (6, ""), (7, "x" * 50_000), (7, "x" * 50_000), (None, "ab")]
    df = spark.createDataFrame([(*r, "k") for r in rows], DOCS + ", keep_id string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df, keep="largest").collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 2, True)}
    sha = {r.doc_id: r.text_sha256 for r in exact_groups(df).collect()}
    assert sha[1] == hashlib.sha256(b"ab").hexdigest() and sha[5] == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 7]
    assert exact_groups(df.limit(0)).count() == 0


def test_hash_collisions_are_excluded(spark, monkeypatch):
    from textloom.llm import exact_dedup as mod

    real = mod._hasher

    def hasher(with_bytes):
        start = real(with_bytes)

        def weak_start():
            step = start()

            def weak(columns):
                out = step(columns)
                return [out[0], [bytes([len(t or "")]) * 16 for t in columns[1]], *out[2:]]

            return weak

        return weak_start

    monkeypatch.setattr(mod, "_hasher", hasher)
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA"), (4, "c")], DOCS)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in exact_groups(df).collect()} == {(1, 1, 2), (3, 1, 2), (2, 2, 1), (4, 4, 1)}


SHARED = [
    (1, "alpha text", "a"),
    (1, "beta text", "b"),  # another text of the same id
    (1, "ALPHA text", "c"),
    (None, "alpha text", "d"),
    (None, "gamma text", "e"),  # without id, but the only one
    (None, "delta text", "f"),
    (None, "Delta text", "g"),
    (2, "beta text", "h"),
    (3, "epsilon", "i"),
    (3, "epsilon", "i"),
]


@pytest.mark.parametrize("dedup", [exact_dedup, near_rows])
def test_every_text_keeps_a_row_whatever_its_id(spark, dedup):
    seen = set()
    for parts, rows in ((1, SHARED), (4, SHARED[::-1])):
        df = spark.createDataFrame(rows, DOCS + ", lang string").repartition(parts)
        kept = [tuple(r) for r in dedup(df).collect()]
        assert sorted(t.lower() for _, t, _ in kept) == ["alpha text", "beta text", "delta text", "epsilon", "gamma text"]
        assert {t.lower(): i for i, t, _ in kept} == {"alpha text": 1, "beta text": 1, "delta text": None, "epsilon": 3, "gamma text": None}
        seen.add(frozenset(kept))
    assert len(seen) == 1  # the same rows in any order of tasks
    assert {r.doc_id for r in exact_dedup(spark.createDataFrame(SHARED, DOCS + ", lang string"), keep="largest").collect()} == {1, 2, 3, None}
    assert dedup(df.limit(0)).count() == 0
