"""Joins, latest-row picks, budgets and merge-style writes over keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.storage import materialise


def latest(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__nr", F.row_number().over(w)).where(F.col("__nr") <= n).drop("__nr")


def pending(df: DataFrame, done: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows that have no partner in done yet."""
    return df.join(done, on, "left_anti")


def neighbours(df: DataFrame, by: str, order: list[str], id_col: str) -> DataFrame:
    """Each row's id with those before and after it."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select(by, id_col, F.lag(id_col).over(w).alias("prev_id"), F.lead(id_col).over(w).alias("next_id"))


def around(df: DataFrame, anchors: DataFrame, by: str, order: str, before: int, after: int) -> DataFrame:
    """Rows from `before` places ahead of each anchor (by, order) to `after` behind: by, anchor, order, offset."""
    w = Window.partitionBy(by).orderBy(order)
    placed = df.select(by, order, F.row_number().over(w).alias("p"))
    at = placed.join(anchors, [by, order], "left_semi").select(by, F.col(order).alias("anchor"), F.explode(F.sequence(F.col("p") - before, F.col("p") + after)).alias("p"), F.col("p").alias("__at"))
    return placed.join(at, [by, "p"]).select(by, "anchor", order, (F.col("p") - F.col("__at")).cast("long").alias("offset"))


def as_of(events: DataFrame, rows: DataFrame, key: str, at: str, ts: str) -> DataFrame:
    """Each event with the rows of its key up to its time; with all of them where none is that old."""
    e = events.select(key, F.col(at).alias("__at"), *[c for c in events.columns if c not in (key,)])
    early = F.min(ts).over(Window.partitionBy(key))
    r = rows.withColumn("__first", early)
    return e.join(r, key).where((F.col(ts) <= F.col("__at")) | (F.col("__first") > F.col("__at"))).drop("__at", "__first")


def prefer(local: DataFrame, remote: DataFrame, key: str, stamp: str) -> DataFrame:
    """Outer merge: the local row unless the remote one is strictly newer; key, stamp, origin."""
    a, b = local.select(key, F.col(stamp).alias("a")), remote.select(key, F.col(stamp).alias("b"))
    newer = F.col("a").isNull() | (F.coalesce(F.try_to_timestamp(F.col("b").cast("string")) > F.try_to_timestamp(F.col("a").cast("string")), F.lit(False)))
    return a.join(b, key, "full").select(key, F.when(newer, F.col("b")).otherwise(F.col("a")).alias(stamp), F.when(newer, "remote").otherwise("local").alias("origin"))


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key; the last of several new ones is up to the caller."""
    return old.join(new.select(*on).distinct(), on, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """old and, once each, the rows of new whose key it lacks."""
    return old.unionByName(new.dropDuplicates(on).join(old.select(*on), on, "left_anti"))


def diff(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """What turns old into new: on, action (keep, insert or delete), counting repeated keys."""
    w = Window.partitionBy(*on).orderBy(*on)
    a = old.select(*on).withColumn("nr", F.row_number().over(w)).withColumn("o", F.lit(1))
    b = new.select(*on).withColumn("nr", F.row_number().over(w)).withColumn("n", F.lit(1))
    return a.join(b, [*on, "nr"], "full").select(*on, F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").otherwise("keep").alias("action"))


def replace_chunks(old: DataFrame, new: DataFrame, doc: str, hash_: str, id_col: str, index: str) -> DataFrame:
    """What a new cut of documents does to their chunks: doc, hash_, id_col, index, action.

    old has doc, hash_, id_col and index, new has doc, hash_ and index.  Of each text of a document the first old chunk
    is moved to the first new place and keeps its id and with it its vectors (update); further places are new
    (insert, no id yet); chunks whose text is gone or unknown go (delete), and further old copies of a text
    that stays remain as they are (leave).  Documents that new does not have are not touched.
    """
    key = [doc, hash_]
    place = new.groupBy(*key).agg(F.min(index).alias(index))
    first = old.groupBy(*key).agg(F.min(F.struct(index, id_col)).alias("__first")).select(*key, F.col(f"__first.{id_col}").alias(id_col))
    moved = first.join(place, key)
    mine = old.join(new.select(doc).distinct(), doc, "left_semi").select(*key, id_col, F.lit(None).cast(dict(new.dtypes)[index]).alias(index))
    none = F.lit(None).cast(dict(old.dtypes)[id_col]).alias(id_col)
    parts = {
        "update": moved,
        "insert": new.join(moved, [*key, index], "left_anti").select(*key, none, index),
        "delete": mine.join(place, key, "left_anti"),
        "leave": mine.join(place, key, "left_semi").join(moved, id_col, "left_anti"),
    }
    found = [rows.select(*key, id_col, index, F.lit(action).alias("action")) for action, rows in parts.items()]
    return reduce(DataFrame.unionByName, found)


def audit(before: DataFrame, after: DataFrame, on: list[str], tool: str, dry_run: bool = False) -> DataFrame:
    """A row per key that a write changes: on, tool, before, after (JSON of the other columns, null where the row
    is not there), dry_run."""
    rest = [c for c in before.columns if c not in on]
    b = before.select(*on, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("before"))
    a = after.select(*on, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("after"))
    changed = b.join(a, on, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select(*on, F.lit(tool).alias("tool"), "before", "after", F.lit(dry_run).alias("dry_run"))


def budget(df: DataFrame, by: str, order: list[Column], size: str, rows: int, bytes_: int) -> DataFrame:
    """Marks for eviction, best candidates first, until a key is within its rows and bytes.

    Rows are dealt by ranges of key and order, so a key of many rows is ranked by many tasks; what lies
    before a range comes from the sums of the ranges, a row per key and range.  A null size is none.
    """
    part = "__part"
    dealt = materialise(df.repartitionByRange(F.col(by), *order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(by, part).agg(F.count("*").alias("__n"), F.sum(F.coalesce(size, F.lit(0))).alias("__b"))
    here, whole = Window.partitionBy(by).orderBy(part).rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy(by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = sums.select(F.col(by).alias("__by"), F.col(part).alias("__at"), F.sum("__n").over(here).alias("__n"), F.sum("__b").over(here).alias("__b"))  # of this range and those after it
    placed = dealt.join(left, F.col(by).eqNullSafe(F.col("__by")) & (F.col(part) == F.col("__at")))
    left_rows = F.col("__n") - F.count("*").over(whole)
    left_bytes = F.col("__b") - F.coalesce(F.sum(F.coalesce(size, F.lit(0))).over(whole), F.lit(0))
    return placed.withColumn("evict", (left_rows > rows) | (left_bytes > bytes_)).select(*df.columns, "evict")


def head_percent(df: DataFrame, order: list[Column], percent: int) -> DataFrame:
    """The ceil(n * percent / 100) first rows, in no order of their own.

    Rows are dealt by ranges of the order; whole ranges are taken by their counts, and only the one
    that the cut falls into is sorted.
    """
    part = "__part"
    dealt = materialise(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = sorted(tuple(r) for r in dealt.groupBy(part).count().collect())  # a row per partition
    left, last = -(-sum(n for _, n in counts) * percent // 100), -1
    for number, n in counts:
        if left < n:
            break
        left, last = left - n, number
    rest = [p for p, _ in counts if p > last]
    whole = dealt.where(F.col(part) <= last)
    if left and rest:
        whole = whole.unionByName(dealt.where(F.col(part) == rest[0]).orderBy(*order).limit(left))
    return whole.drop(part)


def next_index(df: DataFrame, by: str, index: str) -> DataFrame:
    return df.groupBy(by).agg((F.coalesce(F.max(index), F.lit(-1)) + 1).alias("next_index"))
