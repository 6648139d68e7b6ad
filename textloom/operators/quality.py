"""The noise score with its repetition signal, which counts character n-grams of each text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as tx

SHORTEST, LONGEST = 3, 8  # characters of an n-gram


def repetition(text: str) -> float:
    """1 less the greatest share of the text that one repeated n-gram covers."""
    if len(text) < SHORTEST:
        return 1.0
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if code.max() < 256:
        code = code.astype(np.uint64)
    else:
        kinds, code = np.unique(code, return_inverse=True)
        code = code.astype(np.uint64)
        if len(kinds) > 256:
            return _repetition_of_ranks(code, len(text))
    gram, worst, n = code, 0.0, 1
    while n < min(LONGEST, len(text)):  # up to eight characters of eight bits
        n += 1
        gram = gram[:-1] << np.uint64(8) | code[n - 1 :]
        if n < SHORTEST:
            continue
        times = _most(gram)
        if times > 1:
            worst = max(worst, times * n / len(text))
        if times * LONGEST <= worst * len(text):  # no longer n-gram comes more often
            break
    return max(0.0, 1.0 - worst)


def _most(values: np.ndarray) -> int:
    """How often the most frequent value occurs."""
    order = np.sort(values)
    ends = np.flatnonzero(np.concatenate([order[1:] != order[:-1], [True]]))
    return int(np.diff(ends, prepend=-1).max())


def _repetition_of_ranks(code: np.ndarray, size: int) -> float:
    """repetition() of more than 256 kinds of characters: an n-gram is the rank of its head and its last character."""
    gram, worst = code, 0.0
    for n in range(2, min(LONGEST, size) + 1):
        gram = np.unique(gram[:-1] << np.uint64(32) | code[n - 1 :], return_inverse=True)[1].astype(np.uint64)
        times = _most(gram) if n >= SHORTEST else 0
        if times > 1:
            worst = max(worst, times * n / size)
    return max(0.0, 1.0 - worst)


COUNTS = "chars long, visible long, marks long, letters long, capitals long, repetition double"
_SPACE, _CAPITALS = b" \t\n\r\f\x0b", bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _counts(text: str | None) -> tuple:
    """Characters, visible ones, punctuation, ASCII letters and capitals, and repetition."""
    if text is None:
        return None, None, None, None, None, 1.0
    raw = text.encode("utf-8", "surrogatepass")
    n = lambda kind: len(raw) - len(raw.translate(None, kind))
    return len(text), len(text) - n(_SPACE), n(_MARKS), n(_LETTERS), n(_CAPITALS), repetition(text) if text else 1.0


def text_counts(text: Column) -> Column:
    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_counts(t) for t in texts], columns=[c.split()[0] for c in COUNTS.split(", ")])

    return F.pandas_udf(batch, COUNTS)(text)


def repetition_ratio(text: Column) -> Column:
    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: repetition(t) if t else 1.0)

    return F.pandas_udf(batch, "double")(text)


def noise_score(text: Column) -> Column:
    """struct<quality_score, token_rate, punctuation_balance, repetition_ratio, shouting_ratio>; zeros for blank text."""

    def score(c: Column) -> Column:
        parts = {"token_rate": tx.in_band(c["visible"] / c["chars"]), "punctuation_balance": tx.below_ceiling(c["marks"] / c["chars"]), "repetition_ratio": c["repetition"], "shouting_ratio": tx.calm(c["letters"], c["capitals"])}
        blank = F.coalesce(c["visible"] == 0, F.lit(True))
        product = parts["token_rate"] * parts["punctuation_balance"] * parts["repetition_ratio"] * parts["shouting_ratio"]
        zero = lambda x: F.when(blank, 0.0).otherwise(x)
        return F.struct(zero(F.pow(product, F.lit(0.25))).alias("quality_score"), *[zero(x).alias(k) for k, x in parts.items()])

    return tx.let(text_counts(text), score)
