"""Best-fit packing of documents into sequences under several capacities.

Only the histogram of piece lengths, at most one row per token of capacity, comes to the driver.
There bins with the same contents are one run, and each length in turn, longest first, goes to the
run that scores best under every capacity; a run splits at most twice per length, so the plan is as
bounded as the histogram and covers all pieces exactly.  Executors then look their pieces up by
rank within the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import WORD_CACHE, load_tokenizer, shared_encoder
from textloom.llm.common import in_worker, map_batches, materialise

GROUP = 20_000  # pieces that are ranked together


def plan_bins(histogram: dict[int, int], tokens: int, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), score: str = "norm") -> np.ndarray:
    """Vector best-fit decreasing: rows (length, first rank, pieces, first bin, pieces per bin, offset).

    A bin holds at most `tokens` tokens, `documents` pieces and `cost` summed squared lengths (None:
    no such limit).  score "norm" takes the bin whose weighted residual is smallest after the piece,
    "dot" the one whose residual is most aligned with the piece's demand.  An empty histogram gives
    no rows.
    """
    if score not in ("norm", "dot"):
        raise ValueError("score: norm or dot")
    if any(x is not None and x < 1 for x in (tokens, documents, cost)):
        raise ValueError("capacities are positive; None is no limit")
    top = np.array([tokens, documents or np.iinfo(np.int64).max // 4, cost or np.iinfo(np.int64).max // 4], dtype=np.int64)
    use = np.array([tokens > 0, documents is not None, cost is not None]) * np.array(weights)
    left, count, base = np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bins, plan = 0, []
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length * length], dtype=np.int64)
        if (need > top).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        rank, todo = 0, histogram[length]
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            fill = score == "norm" or not len(fits)  # whether a bin that is taken stays the best until it is full
            if len(fits):
                after = (left[fits] - need) / top
                points = (after**2 @ use) if score == "norm" else -((left[fits] / top * (need / top)) @ use)
                at = int(fits[np.argmin(points)])
            else:  # new bins for all that is left
                each = int((top // need).min())
                left, count, base = np.vstack((left, top)), np.append(count, -(-todo // each)), np.append(base, bins)
                bins, at = bins + int(count[-1]), len(count) - 1
            each = int((left[at] // need).min()) if fill else 1
            whole, part = min(int(count[at]), todo // each), 0
            if whole < count[at]:
                part = todo - whole * each
            offset, first, old = int(top[0] - left[at][0]), int(base[at]), left[at].copy()
            new = []
            if whole:
                plan.append((length, rank, whole * each, first, each, offset))
                new.append((old - each * need, whole, first))
            if part:
                plan.append((length, rank + whole * each, part, first + whole, part, offset))
                new.append((old - part * need, 1, first + whole))
            if (rest := int(count[at]) - whole - bool(part)) > 0:
                new.append((old, rest, first + whole + bool(part)))
            new = [x for x in new if x[0].min() > 0]
            left = np.vstack([np.delete(left, at, axis=0), *(x[0] for x in new)])
            count = np.append(np.delete(count, at), [x[1] for x in new]).astype(np.int64)
            base = np.append(np.delete(base, at), [x[2] for x in new]).astype(np.int64)
            rank, todo = rank + whole * each + part, todo - whole * each - part
    return np.array(plan, dtype=np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, tokenizer: str, tokens: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = WORD_CACHE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): a text's ids and end_id, cut every `tokens`."""
    sent = docs.sparkSession.sparkContext.broadcast(load_tokenizer(tokenizer))

    def start():
        enc, end = shared_encoder(tokenizer, sent.value, remembered), np.array([end_id], dtype="<u4").tobytes()

        def step(columns):
            out = [[] for _ in range(5 + with_ids)]
            for i, t in zip(*columns, strict=True):
                packed = enc.encode(t) + end
                for k in range(0, len(packed), 4 * tokens):
                    piece = packed[k : k + 4 * tokens]
                    row = [i, k // (4 * tokens), k // 4, len(piece) // 4, zlib.crc32(piece)]
                    for column, v in zip(out, [*row, np.frombuffer(piece, dtype="<i4")] if with_ids else row, strict=True):
                        column.append(v)
            return out

        return step

    schema = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), start, schema, keep="encoder")


def assign_bins(pieces: DataFrame, plan: np.ndarray, id_col: str = "doc_id") -> DataFrame:
    """pieces with sequence_id and offset, by their rank within their length.

    Repeated rows rank one after the other, so each has a place; no pieces give no rows.
    """
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(id_col, "piece"), F.lit(groups)))
    within = Window.partitionBy("length", "grp").orderBy(id_col, "piece")
    before = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    skips = dealt.groupBy("length", "grp").agg(F.count("*").alias("n")).select("length", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = dealt.withColumn("nr", F.row_number().over(within)).join(skips, ["length", "grp"]).withColumn("rank", F.col("skip") + F.col("nr") - 1)

    # the plan has a few rows per token of capacity, whatever the corpus
    step = int(plan[:, 1].max(initial=0)) + 2
    if len(plan) and int(plan[:, 0].max()) * step > 2**62:
        raise ValueError("too many pieces of one length")
    order = np.argsort(plan[:, 0] * step + plan[:, 1], kind="stable")
    rows = plan[order]
    keys = rows[:, 0] * step + rows[:, 1]
    sent = pieces.sparkSession.sparkContext.broadcast((keys, rows, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, step = sent.value
        for batch in batches:  # the pieces stay in Arrow; only their lengths and ranks are looked at
            length, rank = batch.column(batch.num_columns - 2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            row = rows[np.searchsorted(keys, length * step + np.minimum(rank, step - 1), side="right") - 1]
            k = rank - row[:, 1]
            placed = [pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *placed], names=[*batch.schema.names[:-2], "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.select(*pieces.columns, F.col("length").alias("__length"), F.col("rank").cast("long")).mapInArrow(in_worker(run, "encoder"), f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, tokens: int = 4096, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), score: str = "norm", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, remembered: int = WORD_CACHE) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A document is its text's ids and end_id (null and empty: end_id alone); only one longer than a
    sequence is cut.  `tokens`, `documents` and `cost` (summed squared lengths, the cost of attention
    inside documents) limit a sequence; `remembered` words a worker keep their ids; pieces are cut so that one always fits.  Repeated rows are
    packed as often as they occur; an empty table gives no rows; other columns are not read.
    """
    longest = tokens if cost is None else min(tokens, int(cost**0.5))
    pieces = materialise(token_pieces(docs, tokenizer, longest, end_id, id_col, text_col, with_ids, remembered), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `tokens` rows
    return assign_bins(pieces, plan_bins(histogram, tokens, documents, cost, weights, score), id_col)
