import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import packing
from textloom.llm.registry import tokenizer_path


def best_fit(lengths, tokens):
    bins = []
    for s in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(bins) if r >= s]
        if fits:
            k = min(fits, key=lambda k: bins[k])
            bins[k] -= s
        else:
            bins.append(tokens - s)
    return len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_plan_equals_sequential_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 40), rng.randint(1, 100), 33]) for _ in range(700)]
    hist = {s: lengths.count(s) for s in set(lengths)}
    plan = packing.plan_bins(hist, 100)
    assert max(plan[:, 3] + (plan[:, 2] - 1) // plan[:, 4]) + 1 == best_fit(lengths, 100)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_respects_every_capacity(score):
    rng = random.Random(5)
    hist = {s: rng.randint(1, 90) for s in range(1, 60)}
    plan = packing.plan_bins(hist, 100, 4, 4000, (1.0, 0.5, 2.0), score)
    used, spans = defaultdict(list), defaultdict(int)
    for length, first, n, base, each, offset in plan.tolist():
        spans[length] += n
        for k in range(n):
            used[base + k // each].append((offset + k % each * length, length))
    assert spans == hist
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 100 and len(items) <= 4 and sum(s * s for _, s in items) <= 4000


def test_pack(spark):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, "hello world"), (4, "word " * 9000), (5, "word " * 4095), (5, "word " * 4095)]
    rows += [(i, " ".join(rng.choice(["alpha", "beta", "Naïve!"]) for _ in range(rng.randint(1, 2500)))) for i in range(10, 90)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, length int")
    got = packing.pack(df, tokenizer_path(), with_ids=True).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    bins, parts = defaultdict(list), defaultdict(dict)
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids == ids and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32 and r.start == 4096 * r.piece
        parts[r.doc_id][r.piece] = r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert {i: sum(p.values()) for i, p in parts.items()} == {i: len(v) for i, v in want.items()}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == best_fit([r.length for r in got], 4096)
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


def sequential(lengths, tokens, documents, cost, score):
    """Vector best-fit decreasing, one piece and one bin at a time: the residuals of the bins."""
    top = np.array([tokens, documents, cost], float)
    bins = []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n], float)
        fit = [k for k, left in enumerate(bins) if (left >= need).all()]
        if not fit:
            bins.append(top.copy())
            fit = [len(bins) - 1]
        if score == "norm":
            best = min(fit, key=lambda k: ((((bins[k] - need) / top) ** 2).sum(), k))
        else:
            best = min(fit, key=lambda k: (-((bins[k] / top) * (need / top)).sum(), k))
        bins[best] = bins[best] - need
    return sorted(tuple(b.astype(int).tolist()) for b in bins)


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize(("seed", "documents", "cost"), [(1, 100, 10_000), (2, 6, 10_000), (3, 100, 3_000), (4, 7, 2_600)])
def test_plan_is_sequential_vector_best_fit(score, seed, documents, cost):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 50, 300).tolist()
    histogram = {int(n): lengths.count(n) for n in set(lengths)}
    left = {}
    for n, _, pieces, first, each, _ in packing.plan_bins(histogram, 100, documents, cost, score=score).tolist():
        for k in range(pieces):
            old = left.setdefault(first + k // each, [100, documents, cost])
            left[first + k // each] = [old[0] - n, old[1] - 1, old[2] - n * n]
    assert min(min(x) for x in left.values()) >= 0
    assert sorted(map(tuple, left.values())) == sequential(lengths, 100, documents, cost, score)


def test_capacities_are_positive():
    for bad in ({"tokens": 0}, {"tokens": 5, "documents": 0}, {"tokens": 5, "cost": 0}):
        with pytest.raises(ValueError):
            packing.plan_bins({1: 1}, **bad)
    assert packing.plan_bins({}, 5, 5, 25).shape == (0, 6)
