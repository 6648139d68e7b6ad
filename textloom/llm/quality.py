"""Quality selection by importance resampling.

Two hashed n-gram models, of the target (texts labelled good) and of all raw text, give each
document the log of their likelihood ratio; with Gumbel noise added, the k documents of the greatest
keys are a sample without replacement in proportion to the ratio.  The raw model counts every
document.  The target model and the sample's size use a bounded, documented number of labelled rows:
half of them count n-grams, the other half say which key separates good from bad best, and k is the
number of documents whose key reaches that one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textloom.llm.common import fresh, in_worker, map_batches, materialise, slices
from textloom.llm.minhash import mix

BUCKETS = 1 << 15
MAX_LABELLED = 20_000
WORD_CACHE = 200_000
TOKENS = re.compile(r"\w+|[^\w\s]+").findall

_LAST = (1 << 63) - 1  # in the place of a missing id
_SAME = np.uint64(0x94D049BB133111EB)


class TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def ngrams(text: str | None, seen: TokenHashes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's words, marks and pairs of them; a token said twice in a row is one pair."""
    tokens = TOKENS(text.lower()) if text else []
    h = np.fromiter(map(seen.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    with np.errstate(over="ignore"):
        pairs = np.where(h[1:] == h[:-1], _SAME, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (mix(np.concatenate((h, pairs))) % np.uint64(buckets)).astype(np.int64)


def gumbel(ids: list, seed: int) -> np.ndarray:
    """Noise that depends on the id and the seed alone, so a lost task draws it again."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(str(i), seed=seed) for i in ids), dtype=np.uint64, count=len(ids))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def labelled(labels: DataFrame, id_col: str, column: str, limit: int) -> DataFrame:
    """At most `limit` rows (id, y), by the hash of their id; rows of one id agree on the smaller label."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(column).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("id"), "id").limit(limit)


class Ratio:
    """Log likelihood ratio of each bucket, and the key from which a document is kept."""

    def __init__(self, weights: np.ndarray, cut: float):
        self.weights, self.cut = weights, cut


def _counts(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams per bucket in the target half of the sample and in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, target, raw = TokenHashes(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.bincount(ngrams(text, seen), minlength=BUCKETS)
                raw += c
                if good:
                    target += c
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], names=["bucket", "target", "raw"])

    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0
    good = sample.where((F.col("y") == 1) & half).select("id", F.lit(True).alias("good"))
    rows = docs.join(F.broadcast(good), "id", "left").select("text", "good")  # at most MAX_LABELLED ids
    sums = rows.mapInArrow(in_worker(run), "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw"))
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, t, r in sums.collect():  # BUCKETS rows
        target[b], raw[b] = t, r
    return target, raw


def _scores(docs: DataFrame, weights: np.ndarray, seed: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def start():
        seen = TokenHashes()

        def step(columns):
            ids, texts = columns[0], columns[1]
            w = [float(sent.value[g].sum()) if len(g := ngrams(t, seen)) else None for t in texts]
            noise = gumbel(ids, seed)
            return [ids, w, [None if x is None else x + g for x, g in zip(w, noise.tolist(), strict=True)]]

        return step

    return map_batches(docs.select("id", "text"), start, "id long, log_weight double, sample_key double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, seed: int = 7) -> Ratio:
    """The models and the cut that tells the held-out half of the labelled rows apart best."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = materialise(labelled(labels, id_col, label_col, max_labelled), "labelled")
    target, raw = _counts(src, sample)
    if not target.sum():
        return Ratio(np.zeros(BUCKETS), -np.inf)
    weights = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 1
    judged = sample.where(half)
    scored = _scores(src.join(F.broadcast(judged), "id", "left_semi"), weights, seed).where("sample_key is not null")
    one = scored.groupBy("id").agg(F.min("sample_key").alias("sample_key"))  # an id may recur
    keys = one.join(F.broadcast(judged), "id").select("sample_key", "y").collect()  # at most max_labelled rows
    good, bad = np.sort([k for k, y in keys if y == 1]), np.sort([k for k, y in keys if y != 1])
    if not len(good) or not len(bad):
        return Ratio(weights, -np.inf)
    cuts = np.sort(np.concatenate((good, bad)))
    gain = 1 - np.searchsorted(good, cuts) / len(good) + np.searchsorted(bad, cuts) / len(bad)
    at = int(gain.argmax())
    lower = cuts[at - 1] if at else cuts[at]
    return Ratio(weights, float((cuts[at] + lower) / 2))


def score(docs: DataFrame, model: Ratio, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, k: int | None = None) -> DataFrame:
    """One row per input row: id_col, log_weight, sample_key, kept.

    Kept are the k greatest keys, ties of keys going to the smaller id and rows without id last; k
    None is the number of keys that reach the model's cut.  A text without n-grams (null, empty,
    blank) has null weight and key and is not kept.  Without labels to learn from, every text with
    n-grams is kept.  Repeated rows are scored alike, and where the k-th is one of them all of them
    are kept; an empty table gives no rows; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = materialise(_scores(src, model.weights, seed), "keys")
    return keyed.select(F.col("id").alias(id_col), "log_weight", "sample_key", _taken(keyed, "id", "sample_key", model, k).alias("kept"))


def _taken(keyed: DataFrame, id_col: str, key_col: str, model: Ratio, k: int | None) -> Column:
    """Whether a row of the written table keyed is among the k of the greatest keys."""
    rows = keyed.select(F.col(key_col).alias("x"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"))
    if k is None:
        k = rows.where(F.col("x") >= F.lit(model.cut)).count()
    least, last = _kth(rows, k)
    tie = (F.col(key_col) == F.lit(least)) & (F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)) <= F.lit(last))
    return F.coalesce((F.col(key_col) > F.lit(least)) | tie, F.lit(False))


def _kth(rows: DataFrame, k: int) -> tuple[float, int]:
    """The k-th greatest key x and the id up to which equal keys are taken, by narrowing the key's range."""
    rows = rows.where("x is not null")
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k <= 0 or not n:
        return np.inf, 0
    if k >= n:
        return low, _LAST
    above = 0  # rows beyond high
    while low < high:
        width, parts = (high - low), 1024
        bins = rows.where((F.col("x") >= low) & (F.col("x") <= high)).select(F.least(F.floor((F.col("x") - low) / width * parts), F.lit(parts - 1)).alias("b"), "x").groupBy("b").agg(F.count("*"), F.min("x"), F.max("x")).collect()
        for _, c, lo, hi in sorted(bins, reverse=True):  # at most 1024
            if above + c >= k:
                low, high = lo, hi
                break
            above += c
    ties = rows.where(F.col("x") == low).select("id").orderBy("id").limit(k - above).agg(F.max("id")).first()[0]
    return low, ties


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, k: int | None = None) -> DataFrame:
    """The rows of docs that score() keeps; all columns stay as they were.

    The keys are computed in one pass and written beside the rows.  Null, empty and blank texts go;
    repeated rows are judged alike, by ties, so that of rows of one id all or none stay; an empty
    table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col, seed=seed)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(id_col), docs.columns.index(text_col)
    key = fresh(docs, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, m = TokenHashes(), sent.value
        for batch in slices(batches):
            found = [float(m.weights[g].sum()) if len(g := ngrams(t, seen)) else None for t in batch.column(place[1]).to_pylist()]
            noise = gumbel(batch.column(place[0]).to_pylist(), seed)
            keys = pa.array([None if w is None else w + x for w, x in zip(found, noise.tolist(), strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, key])

    keyed = materialise(docs.mapInArrow(in_worker(run), StructType([*docs.schema.fields, StructField(key, DoubleType())])), "keyed")
    return keyed.where(_taken(keyed, id_col, key, model, k)).drop(key)
