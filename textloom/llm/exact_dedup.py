"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups.

One Python pass hashes every text; the texts themselves are shuffled once, after equal ones of a
task have met in the partial aggregate, so a group of copies costs one row per task however large
it is.  What is written and joined back is narrow.
"""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fresh, gather, map_batches, materialise, row_key, unique_ids, write_few

_PRINT = "id long, h128 binary, sha string"


def _hasher(with_bytes: bool):
    def start():
        def step(columns):
            ids, texts, *rest = columns
            norm = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower: A-Z only
            out = [ids, [xxhash.xxh3_128_digest(b) for b in norm], [hashlib.sha256(b).hexdigest() for b in norm]]
            return [*out, norm, *rest] if with_bytes else [*out, *rest]

        return step

    return start


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as empty, and empty texts
    are one group.  keep names which id of a group stays, "smallest" or "largest".  Repeated rows
    of one id and text count in group_size and are all kept.  A row without id counts but is never
    kept.  An empty table gives no rows; other columns are not read.
    """
    joined, _ = _grouped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), keep)
    single = F.col("n").isNull()
    keep_id = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(keep_id == F.col("id"), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _grouped(src: DataFrame, keep: str) -> tuple[DataFrame, list[str]]:
    """Rows of src (id, text and perhaps key) with n and keep_id of their group, if it has several rows, and the
    columns that name the group."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    own = ", key string" if "key" in src.columns else ""
    best = F.min("id") if keep == "smallest" else F.max("id")
    byte_groups = map_batches(src.select("id", "text"), _hasher(True), _PRINT + ", norm binary").groupBy("h128", "sha", "norm").agg(F.count("*").alias("n"), best.alias("keep_id"))
    narrow = materialise(gather(byte_groups.select("h128", "sha", "n", "keep_id", F.xxhash64("norm").alias("x"))), "exact-groups")
    if narrow.groupBy("h128").count().where("count > 1").isEmpty():
        groups, rows, key = narrow.select("h128", "n", "keep_id"), map_batches(src, _hasher(False), _PRINT + own), ["h128"]
    else:  # a collision of the 128-bit hash: the bytes themselves are the key
        groups, rows, key = byte_groups.select("h128", "norm", "n", "keep_id"), map_batches(src, _hasher(True), _PRINT + ", norm binary" + own), ["h128", "norm"]
    return rows.join(groups.where("n > 1"), key, "left"), key


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts; all columns stay.

    It is a row of the group's smallest or largest id; a row without id stays only where no row of the group has
    one.  Of several such rows the one with the least hash of all its values stays.  Different texts that share an
    id, or have none, all stay.  Null and empty texts are one group; an empty table gives no rows.  Texts are not
    shuffled again: the rows that go, most often few, are taken out by an anti-join.
    """
    key = fresh(docs, "key")
    unique = unique_ids(docs, id_col)
    keyed = docs.withColumn(key, F.col(id_col).cast("string") if unique else row_key(docs, text_col))
    rows, group = _grouped(keyed.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(key).alias("key")), keep)
    several = rows.where(F.col("n").isNotNull())
    first = several.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(*group).agg(F.min("key").alias("first"))
    # rows of one key are the same in every column
    gone = several.select("key", *group).distinct().join(first, group).where("key <> first").select(F.col("key").alias(key))
    return (keyed if unique else keyed.dropDuplicates([key])).join(write_few(gone, "gone"), key, "left_anti").drop(key)
