"""Helpers shared by the corpus operators: tables in the shared folder and Arrow row mappers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.batches import SLICE, slices
from textloom.storage import materialise

__all__ = ["KEPT", "fresh", "gather", "in_worker", "map_batches", "materialise", "row_key", "slices", "table", "unique_ids", "write_few"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What workers keep between tasks, by name: called to let it go.
KEPT: dict[str, Callable[[], None]] = {}


def in_worker(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow: tasks of one worker hand back the memory that the next one has no use for."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _let_go(keep)
        yield from run(batches)
        _trim()

    return task


def _let_go(keep: str) -> None:
    for name, drop in KEPT.items():
        if name != keep:
            drop()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def gather(df: DataFrame) -> DataFrame:
    """df dealt anew, so that what is written next has files of the session's advisory size, not one a task."""
    return df.hint("rebalance")


def write_few(df: DataFrame, name: str) -> DataFrame:
    """materialise() for a table much narrower than the corpus: as few files as its size or the cluster's cores ask
    for, also where adaptive execution does not merge partitions."""
    spark = df.sparkSession
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    return materialise(gather(df).coalesce(most), name)


def map_batches(df: DataFrame, start: Callable[[], Callable[[list[list]], list[list]]], schema: str, rows: int = SLICE, keep: str = "") -> DataFrame:
    """Rows through Python in Arrow batches.

    start() runs once a task and returns a function from the lists of the input's columns to the
    lists of the output's columns.  keep names what it uses of KEPT.
    """
    kinds = [f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))]
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in slices(batches, rows):
            out = step([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, type=k) for v, k in zip(out, kinds, strict=True)], names=names)

    return df.mapInArrow(in_worker(run, keep), schema)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether id_col, as a long, names every row: never null, never twice."""
    ids = df.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    return ids.where("n > 1 or id is null").isEmpty()


def row_key(df: DataFrame, text_col: str) -> Column:
    """SHA-256 of a row's values: only rows that are the same in every column share it."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    return F.sha2(F.to_json(F.struct(F.struct(*rest).alias("row"), F.sha2(F.col(text_col), 256).alias("text"))), 256)
