"""Sets of texts and of lists as sorted 64-bit hashes of their members, in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.batches import slices
from textloom.storage import materialise

RUN = 4  # words of a text that are one member
TEXTS, TEXT_BYTES = 4096, 8 << 20  # rows that are hashed at once, and their bytes
_ODD = np.array([int.from_bytes(blake2b(bytes([k]), digest_size=8).digest(), "little") | 1 for k in range(2 * RUN)], np.uint64)


def member_sets(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """A table of the sets that are not empty: id, key (the same for equal sets only), n members, h (their hashes, sorted).

    A text's members are its runs of RUN words as in functions.text.shingles(), a list's its elements.
    """
    kind = dict(df.dtypes)
    own = F.col(col) if kind[col] == "string" else F.transform(col, lambda g: F.xxhash64(g))
    rows = df.select(F.col(id_col).alias("id"), own.alias("x")).where("x is not null")
    return materialise(rows.mapInArrow(_sets, f"id {kind[id_col]}, key binary, n int, h array<long>"), "sets")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, TEXTS, TEXT_BYTES):
        x = batch.column(1)
        row, g = _lists(x) if pa.types.is_list(x.type) else word_runs(x)
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            g[lo:hi].sort()
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
        row, g = row[new], g[new]
        at, first = np.unique(row, return_index=True)
        ends = np.append(first, len(g))
        keys = [blake2b(g[lo:hi], digest_size=16).digest() for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
        h = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(g))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(keys, pa.binary()), pa.array(np.diff(ends).astype(np.int32)), h], names=["id", "key", "n", "h"])


def _lists(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    own = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(x)), own), x.flatten().to_numpy().copy()


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of RUN words of the texts; fewer words are one run.

    A run's hash is a sum of its words' 64-bit hashes, each times an odd number of its place.
    """
    lists = pc.ascii_split_whitespace(texts)
    row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    row, words = row[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()
    hashes = np.array([int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in words.dictionary.to_pylist()], np.uint64)
    w = hashes[words.indices.to_numpy()]
    many = np.bincount(row, minlength=len(texts))
    start = np.nonzero(np.arange(len(row)) + RUN <= np.cumsum(many)[row])[0]
    full = sum((w[start + k] * _ODD[k] for k in range(RUN)), np.zeros(len(start), np.uint64))
    # texts of fewer words: places are numbered from the text's own number of words
    short = np.nonzero(many[row] < RUN)[0]
    place = short - (np.cumsum(many) - many)[row[short]]
    few = np.zeros(len(texts), np.uint64)
    np.add.at(few, row[short], w[short] * _ODD[RUN + place] + _ODD[many[row[short]]])
    only = np.nonzero((many > 0) & (many < RUN))[0]
    at, g = np.concatenate([row[start], only]), np.concatenate([full, few[only]])
    order = np.argsort(at, kind="stable")
    return at[order], g[order].view(np.int64)
