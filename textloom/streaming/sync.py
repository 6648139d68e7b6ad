"""Incremental intake: pull decisions, hash-diff micro-batches and echo suppression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pull_decision(here: Column, parent: Column, revision: Column, tombstone: Column) -> Column:
    """tombstone, in_sync, fast_forward or conflict, from the local, parent and revision hashes."""
    return F.when(tombstone, "tombstone").when(here.eqNullSafe(revision), "in_sync").when(here.eqNullSafe(parent), "fast_forward").otherwise("conflict")


def changed(batch: DataFrame, current: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Rows of a batch whose hash differs from the stored one, or whose key is new."""
    return batch.join(current.select(key, hash_col), [key, hash_col], "left_anti")


def without_echoes(batch: DataFrame, written: DataFrame, key: str, hash_col: str, at: str, seconds: int = 5) -> tuple[DataFrame, DataFrame]:
    """(batch without what this host wrote within `seconds` before, written without the entries so used)."""
    w = written.select(key, hash_col, F.col(at).alias("__at"))
    fresh = (F.col(at) >= F.col("__at")) & (F.unix_timestamp(at) - F.unix_timestamp("__at") <= seconds)
    hits = batch.join(w, [key, hash_col]).where(fresh).select(key, hash_col).distinct()
    return batch.join(hits, [key, hash_col], "left_anti"), written.join(hits, [key, hash_col], "left_anti")


def watch_text(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], interval: str = "2 seconds", files_per_batch: int = 32, once: bool = False) -> StreamingQuery:
    """New files of a folder, whole, to handle(batch, id); the interval is the debounce."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = files.select(F.col("_metadata.file_path").alias("source_uri"), F.col("value").alias("text"), F.sha2("value", 256).alias("content_hash"), F.col("_metadata.file_modification_time").alias("modified_at"))
    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per window and key of a stream, closed once the watermark passes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
