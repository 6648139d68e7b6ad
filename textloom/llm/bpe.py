"""BPE encoding and decoding with word ends, by merge ranks.

A word's symbol ids form a doubly linked list; a heap holds the rank and place of adjacent pairs, and
an entry that no longer describes its two symbols is skipped when it comes up.  Words are remembered
up to a bound, so a text costs one lookup per word.  The vocabulary file is read by the driver and
broadcast; its size is that of the tokenizer, whatever the corpus.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import struct
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import KEPT, map_batches

WORD_CACHE = 600_000
MAX_FILE_MB = 64


def load_tokenizer(path: str) -> dict:
    """The JSON description, checked for the one layout that this encoder follows."""
    with open(path, encoding="utf-8") as f:
        raw = f.read(MAX_FILE_MB * 1_000_000 + 1)
    if len(raw) > MAX_FILE_MB * 1_000_000:
        raise ValueError(f"{path} has more than {MAX_FILE_MB} MB")
    spec = json.loads(raw)
    if spec["model"]["type"] != "BPE" or spec["model"].get("unk_token") or spec["pre_tokenizer"]["pretokenizers"][1]["type"] != "ByteLevel":
        raise ValueError("a byte-level BPE with word ends is asked for")
    return spec


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    """words remembers white-space-free pieces of text as packed ids, tokens the other pre-tokens."""

    def __init__(self, spec: dict, remembered: int = WORD_CACHE):
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if len(vocab) > 1 << 16:
            raise ValueError("ids of at most 16 bits are asked for")
        self.ranks = {vocab[a] << 16 | vocab[b]: (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.first = [vocab[s] for s in byte_symbols()]
        self.last = [vocab[s + end] for s in byte_symbols()]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.words: dict[str, bytes] = Remembered(self.chunk, remembered)
        self.tokens: dict[str, bytes] = Remembered(self.merge, remembered)

    def merge(self, token: str) -> bytes:
        """Packed ids of one pre-token."""
        raw, first, rank_of = token.encode("utf-8", "replace"), self.first, self.ranks.get
        n = len(raw)
        sym = [first[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        heap = []
        for i in range(n - 1):
            if found := rank_of(sym[i] << 16 | sym[i + 1]):
                heap.append((found[0], i, sym[i], sym[i + 1], found[1]))  # ordered by rank, then place
        heapify(heap)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while heap:
            _, i, a, b, new = heappop(heap)
            if sym[i] != a or (j := after[i]) >= n or sym[j] != b:  # stale
                continue
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := rank_of(new << 16 | sym[k]):
                    heappush(heap, (found[0], i, new, sym[k], found[1]))
            h = before[i]
            if h >= 0 and (found := rank_of(sym[h] << 16 | new)):
                heappush(heap, (found[0], h, sym[h], new, found[1]))
        ids = [s for s in sym if s >= 0]
        return struct.pack(f"<{len(ids)}I", *ids)

    def chunk(self, piece: str) -> bytes:
        """Packed ids of a piece without white space."""
        if piece.isascii() and piece.isalpha():  # one pre-token, as NFC leaves ASCII alone
            low = piece.lower()
            return self.merge(piece) if low == piece else self.words[low]
        out = []
        for part in self.cut.split(piece) if self.cut and "<" in piece else (piece,):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                # NFC, then lower case code point by code point
                part = unicodedata.normalize("NFC", part)
                low = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
                tokens = (low,) if low.isalpha() else self.split.findall(low)
                out += [(self.words if t.isascii() and t.isalpha() else self.tokens)[t] for t in tokens]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, _PIECES(text))) if text else b""

    def decode(self, packed: bytes) -> str:
        """The vocabulary strings of the ids, put together with spaces as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


class Remembered(dict):
    """Results of a function; beyond `most` of them, those not used again are forgotten."""

    def __init__(self, of, most: int):
        self.of, self.most, self.old = of, most, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.of(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


#: Maximal pieces without a White_Space character, at which the pre-tokens end anyway.
_PIECES = re.compile("[^ \\t\\n\\r\\f\\v\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+").findall
_SHARED: dict[str, Encoder] = {}
KEPT["encoder"] = _SHARED.clear


def shared_encoder(path: str, spec: dict, remembered: int = WORD_CACHE) -> Encoder:
    """One encoder, and one memory of words, for all tasks of a Python worker."""
    key = f"{remembered} {path}"
    if key not in _SHARED:
        _SHARED.clear()
        _SHARED[key] = Encoder(spec, remembered)
        gc.freeze()  # the tables stay; collections need not walk them
    return _SHARED[key]


def bpe_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256 (and ids, with_ids).

    Special tokens written in a text become their ids.  A null or empty text has no ids.  Repeated
    rows give repeated rows; other columns are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(load_tokenizer(tokenizer))

    def start():
        enc = shared_encoder(tokenizer, sent.value)

        def step(columns):
            ids, texts = columns
            packed = [enc.encode(t) for t in texts]
            out = [ids, [len(p) // 4 for p in packed], [hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(enc.decode(p).encode("utf-8", "replace")).hexdigest() for p in packed]]
            return [*out, [np.frombuffer(p, dtype="<i4") for p in packed]] if with_ids else out

        return step

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), start, schema, keep="encoder")
