"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a pair of aggregates and joins written to the shared folder, so nothing but two
numbers a round reaches the driver; rounds grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import write_few


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in edges (a, b), label being the smallest id of its component.

    Loops and null ends are ignored; an empty table gives an empty one.
    """
    now = edges.select("a", "b").where("a <> b")
    mark = None
    while True:
        now = write_few(_small(_large(now)), "stars")
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
