"""Language identification of code-switched text by a linear-chain conditional random field.

Every word is a position, every language a label.  A word's features are its affixes, its character
n-grams and its entries in lexicons learned per language; transitions are learned on sequences that
join parts of one to three texts, the parts of a sampled text making up the whole of it.  Forward-backward gives each word's probabilities, and a text's
language is the one with most expected words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, materialise

PER_LANG = 150  # texts of a language that are learned from
WIDTH = 24  # words of a training sequence's part
MAX_LANGS = 256
SPACE = 1 << 16
LEAST_SEEN = 3  # times that a lexicon's word occurs in the sample
WORD_CACHE = 600_000
RESCALE = 8  # words between divisions that keep messages in range
CELLS = 400_000  # padded words of a batch
WORDS = re.compile(r"[^\W\d_]+").findall


def letters(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


class Grams(dict):
    """Feature string -> its place; short strings recur, so few are hashed twice."""

    def __missing__(self, x: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[x] = h = zlib.crc32(x.encode("utf-8", "replace")) % SPACE
        return h


class Crf:
    def __init__(self, langs: list[str], lexicon: dict[str, list[int]]):
        n = len(langs)
        self.langs, self.lexicon, self.grams = langs, lexicon, Grams()
        self.w = np.zeros((SPACE + n, n))
        self.trans, self.begin = np.zeros((n, n)), np.zeros(n)

    def features(self, word: str) -> list[int]:
        """Hashed prefixes and suffixes up to 3, pairs and triples of characters, lexicon entries."""
        b, seen, n = f"<{word}>", self.grams, len(word)
        out = [seen[b[i : i + 2]] for i in range(n + 1)]
        out += [seen[b[i : i + 3]] for i in range(n)]
        out += [seen["^" + word[:1]], seen["^" + word[:2]], seen["^" + word[:3]], seen[word[-1:] + "$"], seen[word[-2:] + "$"], seen[word[-3:] + "$"]]
        return out + [SPACE + k for k in self.lexicon.get(word, ())]

    def emission(self, word: str) -> np.ndarray:
        return self.w[self.features(word)].sum(axis=0)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Rows of label scores of many words at once."""
        ids, starts = [], []
        for w in words:
            starts.append(len(ids))
            ids += self.features(w)
        return np.add.reduceat(self.w[ids], starts, axis=0) if words else np.zeros((0, len(self.langs)))

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label probabilities (texts, words, labels) from emissions padded to one length."""
        n, width, labels = scores.shape
        order = np.argsort(lengths, kind="stable")
        # time first, short texts first: the texts that go on at t are a slice
        e = np.ascontiguousarray(np.exp(scores - scores.max(axis=2, keepdims=True))[order].transpose(1, 0, 2))
        going = np.searchsorted(lengths[order], np.arange(width), side="right").tolist()
        a = np.exp(self.trans - self.trans.max())
        ahead, back = np.zeros_like(e), np.ones_like(e)
        now, was = np.exp(self.begin - self.begin.max()) * e[0], 0
        ahead[0] = now
        for t in range(1, width):
            k = going[t]
            now = (now[k - was :] @ a) * e[t, k:]
            if not t % RESCALE:
                now /= now.sum(axis=1, keepdims=True)
            ahead[t, k:], was = now, k
        for t in range(width - 1, 0, -1):
            k = going[t]
            now = (back[t, k:] * e[t, k:]) @ a.T
            if not t % RESCALE:
                now /= now.sum(axis=1, keepdims=True)
            back[t - 1, k:] = now
        ahead *= back
        ahead /= np.maximum(ahead.sum(axis=2, keepdims=True), 1e-300)
        out = np.empty_like(scores)
        out[order] = ahead.transpose(1, 0, 2)
        return out

    def train(self, sequences: list[list[tuple[str, int]]], epochs: int = 2, batch: int = 32, rate: float = 0.25, l2: float = 1e-5) -> None:
        """Adagrad on the conditional log-likelihood; the sequences are of any lengths."""
        sums = [np.full_like(x, 1e-6) for x in (self.w, self.trans, self.begin)]
        memo: dict[str, list[int]] = {}
        rng, n = np.random.default_rng(1), len(self.langs)
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for k in range(0, len(order), batch):
                part = [sequences[i] for i in order[k : k + batch]]
                lengths = np.array([len(s) for s in part])
                width = int(lengths.max())
                scores, truth = np.zeros((len(part), width, n)), np.zeros((len(part), width, n))
                ids, at = [], []
                for i, s in enumerate(part):
                    for t, (word, label) in enumerate(s):
                        f = memo.get(word) or memo.setdefault(word, self.features(word))
                        scores[i, t] = self.w[f].sum(axis=0)
                        truth[i, t, label] = 1
                        ids += f
                        at += [i * width + t] * len(f)
                inside = (np.arange(width)[None, :] < lengths[:, None])[:, :, None]
                p = self.marginals(scores, lengths) * inside
                diff = (truth - p).reshape(-1, n)
                gw = np.zeros_like(self.w)
                np.add.at(gw, np.array(ids), diff[np.array(at)])
                gt = np.einsum("itk,itl->kl", truth[:, :-1], truth[:, 1:]) - self._pairs(scores, lengths, p)
                gb = (truth[:, 0] - p[:, 0]).sum(axis=0)
                for x, s, g in zip((self.w, self.trans, self.begin), sums, (gw, gt, gb), strict=True):
                    g = g / len(part) - l2 * x
                    s += g * g
                    x += rate * g / np.sqrt(s)

    def _pairs(self, scores: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected transitions: forward and backward messages met at each pair of words."""
        n, width, labels = scores.shape
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        a, start = np.exp(self.trans - self.trans.max()), np.exp(self.begin - self.begin.max())
        ahead = [start * e[:, 0]]
        for t in range(1, width):
            now = (ahead[-1] / ahead[-1].sum(axis=1, keepdims=True) @ a) * e[:, t]
            ahead.append(now)
        total, back = np.zeros((labels, labels)), np.ones((n, labels))
        for t in range(width - 1, 0, -1):
            back[lengths - 1 <= t] = 1.0
            joint = ahead[t - 1][:, :, None] * a[None] * (e[:, t] * back)[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            total += joint[t < lengths].sum(axis=0)
            back = (back * e[:, t]) @ a.T
            back /= back.sum(axis=1, keepdims=True)
        return total


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Crf:
    """Learns from at most per_lang whole texts of each language, by the hash of their id; held-out ids are left out.

    Rows without id, text or language teach nothing, of rows of one id and language one does; without
    any, no language is known.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & ~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()]
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = materialise(rows.select("id", "lang").distinct().withColumn("nr", F.row_number().over(first)).where(F.col("nr") <= per_lang).select("id", "lang"), "sample")

    def start():
        def step(columns):
            out = [[], [], []]
            for i, t, lang in zip(*columns, strict=True):
                w = letters(t)
                for k in range(0, len(w), WIDTH):
                    for column, x in zip(out, (i, w[k : k + WIDTH], lang), strict=True):
                        column.append(x)
            return out

        return step

    # per_lang texts of a language at most, one an id
    texts = rows.join(F.broadcast(picked), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("id", "text", "lang")
    found = sorted((r[2], r[0], r[1]) for r in map_batches(texts, start, "id long, words array<string>, lang string").collect())
    return learn(found, sorted(langs))


def learn(found: list[tuple[str, int, list[str]]], langs: list[str]) -> Crf:
    """found: (language, id, words of a part of a text)."""
    counts = {lang: Counter() for lang in langs}
    for lang, _, words in found:
        counts[lang].update(words)
    # a word has an entry for every language in whose sample it recurs
    lexicon: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        for word, n in counts[lang].items():
            if n >= LEAST_SEEN:
                lexicon.setdefault(word, []).append(k)
    crf = Crf(langs, lexicon)
    number = {lang: k for k, lang in enumerate(langs)}
    rng = np.random.default_rng(2)
    sequences = []
    order = rng.permutation(len(found))
    k = 0
    while k < len(order):
        n = int(rng.integers(1, 4))
        sequences.append([(w, number[found[i][0]]) for i in order[k : k + n] for w in found[i][2]])
        k += n
    if langs:
        crf.train([s for s in sequences if s])
    return crf


def predict(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, held_out, lang_pred, score, n_words, n_switches.

    score is the mean probability of lang_pred over the words, n_switches the changes between the
    most probable languages of neighbouring words.  A text that is null or has no letter is `und`
    with score 0, and so is every text if no language was learned.  A null id is not held out.
    Repeated rows are judged alike; an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def start():
        model = sent.value
        n = len(model.langs)
        row_of: dict[str, int] = {}
        rows = np.zeros((WORD_CACHE, max(n, 1)), np.float32)

        def emissions(words: list[str]) -> np.ndarray:
            if len(words) > WORD_CACHE // 2:
                return np.concatenate([emissions(words[k : k + WORD_CACHE // 2]) for k in range(0, len(words), WORD_CACHE // 2)])
            if len(row_of) + len(words) > WORD_CACHE:
                row_of.clear()
            new = [w for w in dict.fromkeys(words) if w not in row_of]
            if new:
                good = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
                first = len(row_of)
                rows[first : first + len(good)] = model.emissions(good)
                row_of.update(zip(good, range(first, first + len(good)), strict=True))
            if new and len(good) < len(new):  # numerals that the pattern takes for letters
                words = [w for w in words if w in row_of]
            return rows[np.fromiter(map(row_of.__getitem__, words), dtype=np.int64, count=len(words))]

        def step(columns):
            ids, texts = columns
            pred, score, count, switch = ["und"] * len(ids), [0.0] * len(ids), [0] * len(ids), [0] * len(ids)
            flush_cells = 0
            queue = []

            def flush():
                queue.sort(key=lambda x: len(x[1]))
                k = 0
                while k < len(queue):
                    m = k + 1
                    while m < len(queue) and m - k < 512 and (m - k + 1) * len(queue[m][1]) <= CELLS:
                        m += 1
                    part = queue[k:m]
                    lengths = np.array([len(e) for _, e in part])
                    padded = np.zeros((len(part), int(lengths.max()), n))
                    for row, (_, e) in zip(padded, part, strict=True):
                        row[: len(e)] = e
                    p = model.marginals(padded, lengths)
                    for q, (i, e) in zip(p, part, strict=True):
                        q = q[: len(e)]
                        mean = q.mean(axis=0)
                        best = int(mean.argmax())
                        labels = q.argmax(axis=1)
                        pred[i], score[i], count[i], switch[i] = model.langs[best], round(float(min(1.0, mean[best])), 6), len(e), int((labels[1:] != labels[:-1]).sum())
                    k = m
                queue.clear()

            for i, t in enumerate(texts):
                words = letters(t) if n else []
                e = emissions(words) if words else ()
                if len(e):
                    queue.append((i, e))
                    flush_cells += len(e)
                    if flush_cells > 4 * CELLS:
                        flush()
                        flush_cells = 0
            flush()
            return [ids, pred, score, count, switch]

        return step

    out = map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), start, f"`{id_col}` long, lang_pred string, score double, n_words long, n_switches long", rows=8192)
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
