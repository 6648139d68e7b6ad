"""Chunkers: columnar where the cut points are arithmetic, Arrow-batched where they depend on the text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.batches import slices

TEXT_BYTES, ROW_BYTES = 2 << 20, 100  # of the texts or pieces that a worker holds at a time; of a piece without its text

def fixed_window(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """array<struct<index, start, text>> of windows that overlap; the first to reach the end is the last."""
    if overlap >= size:
        raise ValueError("the overlap must be less than the size")
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - overlap) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("index"), (i * step).alias("start"), F.substring(text, i * step + 1, F.lit(size)).alias("text")))
    return F.when(n > 0, cut).otherwise(F.array().cast(cut_type()))


def cut_type() -> str:
    return "array<struct<index:int,start:int,text:string>>"


def hard_max(text: Column, most: int) -> Column:
    """Equal slices of at most `most` characters."""
    n = F.length(text)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / most).cast("int") - 1)), lambda i: F.struct(i.alias("index"), (i * most).alias("start"), F.substring(text, i * most + 1, F.lit(most)).alias("text")))
    return F.when(n > 0, cut).otherwise(F.array().cast(cut_type()))


def per_message(messages: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """One chunk for each message that is not blank; the message's place goes along."""
    return messages.where(F.length(F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f\\x0B]", ""))) > 0).select(conv, F.col(turn).alias("turn"), F.col(text).alias("text"))


def sliding_window(messages: DataFrame, conv: str, turn: str, text: str, size: int = 3, stride: int = 2) -> DataFrame:
    """`size` messages joined by blank lines every `stride`, up to the first window that reaches the end."""
    order = Window.partitionBy(conv).orderBy(turn)
    ahead = order.rowsBetween(0, size - 1)
    whole = Window.partitionBy(conv)
    rows = messages.select(conv, (F.row_number().over(order) - 1).alias("i"), F.collect_list(F.coalesce(text, F.lit(""))).over(ahead).alias("parts"), F.count("*").over(whole).alias("n"))
    starts = (F.col("i") % stride == 0) & ((F.col("i") == 0) | (F.col("i") - stride + size < F.col("n")))
    joined = F.array_join("parts", "\n\n")
    return rows.where(starts).select(conv, F.col("i").cast("long").alias("first_turn"), joined.alias("text")).where(F.length(F.regexp_replace("text", "[ \\t\\n\\r\\f\\x0B]", "")) > 0)


def markdown_pieces(text: str, size: int = 1500, overlap: int = 200) -> Iterator[tuple[int, str, str | None]]:
    """(start, text, heading): cuts after a blank line, else after a sentence, else at white space."""
    start, n = 0, len(text)
    while start < n:
        end = start + size
        if end < n:
            cut = text.rfind("\n\n", start, end)
            if cut > start:
                end = cut + 2
            else:
                stops = [m.end() for m in re.finditer(r"\.(?=[ \n\t])", text[start : end + 1]) if m.end() <= size and m.start() > 0]
                gaps = [] if stops else [m.start() for m in re.finditer(r"[ \n\t]", text[start:end]) if m.start() > 0]
                end = start + (stops[-1] if stops else gaps[-1] if gaps else size)
        else:
            end = n
        piece = text[start:end]
        heads = (ln.lstrip("#").strip() for ln in piece.splitlines() if ln.startswith("#"))
        yield start, piece, next((h for h in heads if h), None)
        if end >= n:
            return
        start = end - overlap if end - overlap > start else end


def _gear(n: int = 256) -> list[int]:
    return [int.from_bytes(hashlib.sha256(bytes([k])).digest()[:8], "big") for k in range(n)]


GEAR = _gear()


def content_defined(data: bytes, least: int = 256, average: int = 1024, most: int = 4096) -> Iterator[tuple[int, int]]:
    """(start, end) by a rolling Gear hash: a harder mask before the average size, an easier one after; never inside a UTF-8 character."""
    bits = average.bit_length() - 1
    hard, easy = ((1 << bits + 1) - 1) << 40, ((1 << bits - 1) - 1) << 40
    start, n, full = 0, len(data), (1 << 64) - 1
    while start < n:
        h, end = 0, min(start + most, n)
        for i in range(start + least, end):
            h = (h << 1 & full) + GEAR[data[i]] & full
            if not h & (hard if i - start < average else easy):
                end = i + 1
                break
        while end < n and data[end] & 0xC0 == 0x80 and end > start + 1:
            end -= 1
        yield start, end
        start = end


def code_pieces(text: str, most: int = 1500) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text): runs of lines, cut at blank lines before `most` characters, else where they exceed it."""
    lines = text.splitlines(keepends=True)
    first, size, blank = 0, 0, None
    k = 0
    while k < len(lines):
        if size and size + len(lines[k]) > most:
            cut = blank + 1 if blank is not None and blank + 1 > first else k
            yield first + 1, cut, "".join(lines[first:cut])
            first, size, blank = cut, sum(map(len, lines[cut:k])), None
            continue
        size += len(lines[k])
        if not lines[k].strip():
            blank = k
        k += 1
    if first < len(lines):
        yield first + 1, len(lines), "".join(lines[first:])


def chunk_with(df: DataFrame, id_col: str, text_col: str, cut: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """Rows (id, index, fields...) of a Python chunker; a worker holds a few texts' pieces at a time."""
    schema = T.StructType.fromDDL(f"`{id_col}` long, index int, {fields}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=TEXT_BYTES):
            rows, size = [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                own, text = i.as_py(), t.as_py()
                for k, piece in enumerate(cut(text) if text else ()):
                    rows.append((own, k, *piece))
                    size += ROW_BYTES + sum(len(x) for x in piece if isinstance(x, str))
                    if size > TEXT_BYTES:
                        yield _batch(rows, arrow)
                        rows, size = [], 0
            if rows:
                yield _batch(rows, arrow)

    return df.select(F.col(id_col).cast("long"), text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# fixed values: the chunker of each content class
CHUNKER_OF_CLASS = {
    "code": "code",
    "chat": "conversation",
    "reference": "passthrough",
    "book": "cdc",
    "textbook": "cdc",
    "paper": "cdc",
    "article": "cdc",
    "note": "cdc",
    "other": "cdc",
}
CHUNKERS = ("markdown", "conversation", "passthrough", "code", "cdc")


def chunker_for(class_hint: Column, chunker_hint: Column, fallback: Column) -> Column:
    """The chunker's name: that of the content class, else the hint, else the source's own.

    Null and empty hints are absent; an unknown class or chunker is an error of the query.
    """
    known = F.create_map(*[F.lit(x) for pair in CHUNKER_OF_CLASS.items() for x in pair])
    unknown = lambda what, c: F.raise_error(F.concat(F.lit(f"unknown {what}: "), c)).cast("string")
    by_class = F.coalesce(F.try_element_at(known, class_hint), unknown("class", class_hint))
    by_hint = F.when(chunker_hint.isin(*CHUNKERS), chunker_hint).otherwise(unknown("chunker", chunker_hint))
    return F.when(class_hint != "", by_class).when(chunker_hint != "", by_hint).otherwise(fallback)
