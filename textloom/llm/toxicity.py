"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each model sees a text's words, their stems and the probabilities
of the categories before it.  In training those are out-of-fold, so a later model learns how far the
earlier ones can be trusted.  Models are fitted on a bounded, documented number of labelled rows, by
whose features alone anything comes to the driver.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, materialise
from textloom.llm.quality import TOKENS

MAX_LABELLED = 6_000
SPACE = 1 << 20  # hashed words
FEATURES = 768  # words a model sees
LEAST_DOCS = 4  # labelled texts that hold a word at least
FOLDS = 5
WORD_CACHE = 400_000

#: Category: condition over the label columns. Earlier ones feed later ones.
CATEGORIES = {"toxic": "toxic = 1", "toxic_prose": "toxic = 1 and quality = 1", "toxic_noise": "toxic = 1 and quality = 0"}


def word_ids(word: str) -> list[int]:
    """The hashed word and its stems of four and five characters, which inflected forms share."""
    names = [word, *(f"{word[:k]}~" for k in (4, 5) if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) % SPACE for x in names]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def train_linear(x: np.ndarray, y: np.ndarray, rounds: int = 120, l2: float = 0.1) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the bias."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    u = np.ones(x.shape[1], x.dtype)
    for _ in range(20):  # the greatest singular value bounds the curvature
        u = x.T @ (x @ u)
        top = float(np.linalg.norm(u))
        u /= top or 1.0
    scale = 4.0 / max(1e-9, 1.05 * top + 4 * l2)
    w = v = np.zeros(x.shape[1], x.dtype)
    shrink = np.full(x.shape[1], l2, x.dtype)
    shrink[-1] = 0
    for k in range(rounds):
        g = x.T @ (_sigmoid(x @ v) - y) + shrink * v
        new = v - scale * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


class Chain:
    """One linear model per category over the chosen words and the earlier probabilities."""

    def __init__(self, names: list[str], words: np.ndarray, weights: list[np.ndarray], cut: float):
        self.names, self.words, self.weights, self.cut = names, words, weights, cut

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0), np.float64)
        for w in self.weights:
            z = x @ w[: x.shape[1]] + out @ w[x.shape[1] : -1] + w[-1]
            out = np.hstack((out, _sigmoid(z)[:, None]))
        return out


def _places(among: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where the values that occur in a sorted array stand in it."""
    if not len(among):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at[among[at] == values]


def fit_chain(features: list[np.ndarray], y: np.ndarray, names: list[str], most: int = FEATURES, least: int = LEAST_DOCS) -> Chain:
    """features: distinct word ids of each text; y: 0/1 per text and category."""
    held, n = np.unique(np.concatenate([*features, np.empty(0, np.int64)]), return_counts=True)
    held = held[n >= least]
    own = [_places(held, f) for f in features]
    p = np.bincount(np.concatenate([*own, np.empty(0, np.int64)]), minlength=len(held)) / max(1, len(own))
    chosen: set[int] = set()
    for c in range(y.shape[1]):  # words whose presence says most about a category
        pos = np.flatnonzero(y[:, c] == 1)
        if 0 < len(pos) < len(own):
            a = np.bincount(np.concatenate([own[i] for i in pos]), minlength=len(held))
            rest = (p * len(own) - a) / (len(own) - len(pos))
            gain = np.abs(a / len(pos) - rest) / np.sqrt(p * (1 - p) + 1e-6)
            chosen |= set(np.argsort(-gain, kind="stable")[: most // y.shape[1]].tolist())
    order = np.array(sorted(chosen), dtype=np.int64)
    words, x = held[order], np.zeros((len(own), len(order)), np.float32)
    for row, f in zip(x, own, strict=True):
        row[_places(order, f)] = 1
    fold = np.arange(len(x)) % FOLDS
    weights, outside = [], np.zeros((len(x), 0), np.float32)
    for c in range(y.shape[1]):
        full, target = np.hstack((x, outside)), y[:, c].astype(np.float32)
        weights.append(train_linear(full, target))
        p = np.zeros(len(x), np.float32)
        for k in range(FOLDS):
            inside = fold != k
            if (~inside).any() and inside.any():
                w = train_linear(full[inside], target[inside])
                p[~inside] = _sigmoid(full[~inside] @ w[:-1] + w[-1])
        outside = np.hstack((outside, p[:, None]))
    return Chain(names, words, weights, _best_cut(outside[:, 0], y[:, 0]))


def _best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that gives the best F1 out of fold, half-way to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order] == 1)
    if not len(p) or not hits[-1]:
        return np.inf
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    at = int(f1.argmax())
    low = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float((p[order[at]] + low) / 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", categories: dict[str, str] | None = None, max_labelled: int = MAX_LABELLED, features: int = FEATURES, least_docs: int = LEAST_DOCS) -> Chain:
    """The chain fitted on at most max_labelled labelled rows, by the hash of their id.

    A model sees the `features` words, of those that least_docs texts hold, that say most about the
    categories.  Labels without id or first category teach nothing, those of one id are united; null
    texts are left out, and of texts of one id one is taken.  Without labels nothing is flagged.
    """
    categories = categories or CATEGORIES
    flags = [F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(f"y{k}") for k, c in enumerate(categories.values())]
    known = labels.where(F.col(id_col).isNotNull() & F.expr(next(iter(categories.values()))).isNotNull())
    sample = materialise(known.groupBy(F.col(id_col).cast("long").alias("id")).agg(*flags).orderBy(F.xxhash64("id"), "id").limit(max_labelled), "labelled")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    own = [f"y{k}" for k in range(len(flags))]
    found = texts.join(F.broadcast(sample), "id").groupBy("id", *own).agg(F.min("text").alias("text")).select("id", "text", *own)  # at most max_labelled rows

    def start():
        def step(columns):
            words = [sorted({i for w in set(TOKENS(t.lower())) for i in word_ids(w)}) for t in columns[1]]
            return [columns[0], words, [list(y) for y in zip(*columns[2:], strict=True)]]

        return step

    rows = sorted(map_batches(found, start, "id long, words array<long>, y array<int>").collect(), key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[0]))
    y = np.array([r[2] for r in rows], dtype=np.int64).reshape(-1, len(categories))
    return fit_chain([np.array(r[1], np.int64) for r in rows], y, list(categories), features, least_docs)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, a probability p_<category> of each category, flagged.

    flagged: the first category's probability reaches the cut that was best out of fold.  A null or
    empty text has no words, so it gets the chain's probabilities for none and is never flagged.
    Without a labelled case nothing is flagged.  Repeated rows are scored alike; an empty table
    gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def start():
        c = sent.value
        at = {int(w): k for k, w in enumerate(c.words)}
        seen: dict[str, tuple[int, ...]] = {}

        def place(word: str) -> tuple[int, ...]:
            k = seen.get(word)
            if k is None:
                if len(seen) >= WORD_CACHE:
                    seen.clear()
                k = seen[word] = tuple([at[i] for i in word_ids(word) if i in at])
            return k

        def step(columns):
            ids, texts = columns
            x = np.zeros((len(ids), len(at)), np.float32)
            for row, t in zip(x, texts, strict=True):
                if t:
                    row[[k for w in set(TOKENS(t.lower())) for k in place(w)]] = 1
            p = np.round(c.predict(x), 6)  # alike in batches of any size
            return [ids, *[p[:, k].tolist() for k in range(p.shape[1])], [bool(q >= c.cut and t) for q, t in zip(p[:, 0], texts, strict=True)]]

        return step

    names = ", ".join(f"`p_{n}` double" for n in chain.names)
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), start, f"`{id_col}` long, {names}, flagged boolean")
