"""Search as a user asks it: two lists, fusion, boosts, a pool, a second score, the best k; and what hangs on hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as vx
from textloom.functions.text import is_symbol_shaped
from textloom.operators import retrieval as rt

SYMBOL_ALPHA = 0.3  # weight of the dense side for queries that look like identifiers


def alpha_of(query: Column, usual: float) -> Column:
    """The dense side's weight: identifiers lean on words."""
    return F.when(is_symbol_shaped(query), SYMBOL_ALPHA).otherwise(usual)


def blend_by(dense: DataFrame, lexical: DataFrame, alphas: DataFrame) -> DataFrame:
    """blend() with an alpha of each query: alphas has query_id and alpha."""
    w = Window.partitionBy("query_id")
    scaled = lambda df, name: df.select("query_id", "id", vx.min_max(F.col("score"), w).alias(name))
    j = scaled(dense, "a").join(scaled(lexical, "b"), ["query_id", "id"], "full").join(alphas, "query_id")
    return j.select("query_id", "id", (F.col("alpha") * F.coalesce("a", F.lit(0.0)) + (1 - F.col("alpha")) * F.coalesce("b", F.lit(0.0))).alias("score"))


def search(dense: DataFrame, lexical: DataFrame, k: int, alphas: DataFrame | None = None, tokens: DataFrame | None = None, definitions: DataFrame | None = None, pool: DataFrame | None = None, again: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """The k best (query_id, id, score, rank) of two lists that hold 2 * k a query.

    Fused by rank, or by scaled scores where alphas (query_id, alpha) are given; only ids of the pool
    (query_id, id) if there is one; definitions (id, name) whose name is among a query's tokens
    (query_id, tokens) count half as much again.  again (query_id, id, score) are second scores: they
    order the 2 * k first hits, ties by the first score, then by id.
    """
    fused = rt.fuse_ranks(dense, lexical) if alphas is None else blend_by(dense, lexical, alphas)
    if pool is not None:
        fused = fused.join(pool, ["query_id", "id"], "left_semi")
    if tokens is not None and definitions is not None:
        named = fused.join(tokens, "query_id", "left").join(definitions, "id", "left").withColumn("is_definition", F.col("name").isNotNull())
        fused = rt.boost(named, "tokens", "name", "is_definition").select("query_id", "id", "score")
    fused = fused.withColumn("score", F.round("score", digits) + 0.0)
    if again is None:
        return rt.top_k(fused, k)
    first = rt.top_k(fused, 2 * k).drop("rank").withColumnRenamed("score", "first")
    both = first.join(again, ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("first"), "id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def binary_metrics(ranked: DataFrame, gold: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """nDCG@k and MRR@k of gold (query_id, id) without grades; a query without hits scores 0."""
    good = gold.select("query_id", "id").distinct()
    hit = ranked.where(F.col("rank") <= k).join(good, ["query_id", "id"]).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    wanted = good.groupBy("query_id").agg(F.count("*").alias("n"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    return wanted.join(hit, "query_id", "left").select("query_id", zero(F.col("dcg") / ideal).alias("ndcg"), zero(1.0 / F.col("first")).alias("mrr"))


def repaired_gold(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """gold (query_id, id, content_hash) with the ids that chunks (id, content_hash) have now: the id where it still
    holds the text, else the least id that does; drifted says so, and what is nowhere has no id."""
    same = gold.join(chunks.select("id", F.col("content_hash").alias("__now")), "id", "left")
    by_hash = chunks.groupBy("content_hash").agg(F.min("id").alias("__other"))
    moved = same.join(by_hash, "content_hash", "left")
    stays = F.coalesce(F.col("__now") == F.col("content_hash"), F.lit(False))
    return moved.select("query_id", F.when(stays, F.col("id")).otherwise(F.col("__other")).alias("id"), (~stays).alias("drifted"))


def lookup(chunks: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The chunks of given ids, documents or content hashes (a table with that column)."""
    return chunks.join(keys.select(on).distinct(), on, "left_semi")


def hydrate(hits: DataFrame, chunks: DataFrame, labels: DataFrame, feedback: DataFrame, order: list[Column]) -> DataFrame:
    """hits with their chunk's columns, sorted labels and latest feedback (id, kind, ...)."""
    named = labels.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
    w = Window.partitionBy("id").orderBy(*order)
    last = feedback.withColumn("__nr", F.row_number().over(w)).where("__nr = 1").select("id", F.col("kind").alias("last_feedback"))
    return hits.join(chunks, "id", "left").join(named, "id", "left").join(last, "id", "left")
