"""What to look at next: candidates, what they lack, how they stand out, the next one and the next batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as vx

# The fields that a complete candidate has, in order
FIELDS = ["title", "heading", "labels", "description", "language", "source_uri"]
WORDS = ["title", "heading", "description", "language"]


def missing_fields(df: DataFrame, known_suffix: Column) -> DataFrame:
    """df (with FIELDS; labels an array) and missing (names, in order) and missing_score, their share of six.

    A uri counts as missing unless known_suffix holds for it.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    lacks = {c: blank(c) for c in WORDS} | {"labels": F.coalesce(F.size("labels"), F.lit(0)) < 1, "source_uri": blank("source_uri") | ~F.coalesce(known_suffix, F.lit(False))}
    names = F.filter(F.array(*[F.when(lacks[c], F.lit(c)) for c in FIELDS]), lambda x: x.isNotNull())
    return df.withColumn("missing", names).withColumn("missing_score", F.size("missing") / len(FIELDS))


def elevation(df: DataFrame, vector: str, second: str | None = None) -> DataFrame:
    """df with elevation: a second score where there is one, else the distance from the mean vector scaled to [0, 1]
    (0.5 where all are as far), else 0.5.

    Least and greatest distance are one row, so nothing is gathered in one task.
    """
    mean = df.where(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    center = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("__center"))  # one row
    far = df.join(F.broadcast(center)).withColumn("__far", vx.cosine_distance(F.col(vector), F.col("__center")))
    span = far.agg(F.min("__far").alias("__low"), F.max("__far").alias("__high"))
    width = F.col("__high") - F.col("__low")
    scaled = F.when(F.col(vector).isNull(), 0.5).when(width < 1e-12, 0.5).otherwise((F.col("__far") - F.col("__low")) / width)
    first = scaled if second is None else F.coalesce(F.col(second), scaled)
    return far.join(F.broadcast(span)).withColumn("elevation", first).drop("__center", "__far", "__low", "__high")


def candidates(chunks: DataFrame, labels: DataFrame, namespace: str) -> DataFrame:
    """chunks (id, ...) with their sorted labels, class and confidence: the surest class label, ties to the least."""
    own = labels.groupBy("id").agg(F.sort_array(F.collect_set(F.concat("namespace", F.lit(":"), "value"))).alias("labels"))
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("confidence"), "value")
    best = labels.where(F.col("namespace") == namespace).withColumn("__nr", F.row_number().over(w)).where("__nr = 1").select("id", F.col("value").alias("class"), "confidence")
    return chunks.join(own, "id", "left").join(best, "id", "left")


def next_target(df: DataFrame, score: str, id_col: str) -> DataFrame:
    """The row of the greatest score, ties to the least id."""
    return df.orderBy(F.desc(score), id_col).limit(1)


def next_batch(df: DataFrame, by: list[str], score: str, id_col: str, size: int) -> DataFrame:
    """The group of the greatest mean score over its `size` best rows, with that mean and its cohesion 1 / (1 + variance)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    head = df.withColumn("__nr", F.row_number().over(w)).where(F.col("__nr") <= size)
    groups = head.groupBy(*by).agg(F.avg(score).alias("mean_score"), (1 / (1 + F.var_pop(score))).alias("cohesion"), F.count("*").alias("n"))
    return groups.orderBy(F.desc(F.round("mean_score", 9)), *by).limit(1)


def prune_summary(df: DataFrame, stem: Column, score: str) -> DataFrame:
    """What a prune would take by stem: its rows and mean score; nothing is deleted."""
    return df.groupBy(stem.alias("stem")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))


def ewma(df: DataFrame, by: str, order: list[Column], sample: str, alpha: float) -> DataFrame:
    """The exponentially weighted mean of each key's samples in order, and their number.

    A sample's weight follows from its place from the end, so the fold is a sum.
    """
    w = Window.partitionBy(by)
    r = df.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    weight = F.pow(F.lit(1.0 - alpha), F.col("__n") - F.col("__r")) * F.when(F.col("__r") == 1, 1.0).otherwise(alpha)
    return r.groupBy(by).agg(F.sum(weight * F.col(sample)).alias("rate"), F.count("*").alias("samples"))
