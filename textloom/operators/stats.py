"""Distributions of token counts, exact duplicates, centroids and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as tx


def token_stats(df: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """n, total, min, max, mean, p50 and p95 (interpolated, cut to whole numbers, p95 at least p50)."""
    cut = lambda p: F.floor(F.percentile(tokens, F.lit(p)) + 1e-9).cast("long")
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(tokens).alias("total"), F.min(tokens).alias("min"), F.max(tokens).alias("max"), F.avg(tokens).alias("mean"), cut(0.5).alias("p50"), cut(0.95).alias("p95"))
    return out.withColumn("p95", F.greatest("p95", "p50"))


def histogram_edges(low: Column, high: Column, bins: int, log: bool = False) -> Column:
    """bins + 1 whole, strictly rising edges; rounding is half to even."""
    grid = F.sequence(F.lit(0), F.lit(bins))
    if log:
        a, b = F.log10(F.greatest(low, F.lit(1))), F.log10(F.greatest(high, F.lit(1)))
        raw = F.when(a == b, F.transform(grid, lambda i: (low + i).cast("double"))).otherwise(F.transform(grid, lambda i: F.pow(F.lit(10.0), a + i * ((b - a) / bins))))
    else:
        raw = F.when(low == high, F.transform(grid, lambda i: (low + i).cast("double"))).otherwise(F.transform(grid, lambda i: low + i * ((high - low) / bins)))
    whole = F.transform(raw, lambda x: F.bround(x, 0).cast("long"))
    return F.aggregate(whole, F.array().cast("array<long>"), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(F.concat(acc, F.array(F.greatest(x, F.try_element_at(acc, F.lit(-1)) + 1)))))


def length_histogram(df: DataFrame, value: Column, bins: int = 10, log: bool = False) -> DataFrame:
    """Rows (bin, lo, hi, n): each value in the last bin whose lower edge it reaches; empty bins are 0."""
    data = df.select(value.alias("v"))
    edges = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null").select(histogram_edges(F.col("lo"), F.col("hi"), bins, log).alias("e"))
    counted = data.crossJoin(F.broadcast(edges)).select(F.size(F.filter(F.slice("e", 2, bins - 1), lambda e: e <= F.col("v"))).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    frame = edges.select(F.posexplode(F.slice("e", 1, bins)).alias("bin", "lo"), "e").select("bin", "lo", F.expr("e[bin + 1]").alias("hi"))
    return frame.join(counted, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def exact_duplicates(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """Groups of two or more ids of one content hash: hash, cluster, n, least and greatest id."""
    # ids meet per group only to name it; the groups are those of one hash
    g = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(id_col)).alias("ids")).where("n >= 2")
    return g.select(hash_col, tx.cluster_id(F.col("ids")).alias("cluster_id"), "n", F.element_at("ids", 1).alias("least_id"), F.element_at("ids", -1).alias("greatest_id"))


def centroid(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """Mean of each component: rows (by..., pos, mean)."""
    return df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def ks_two_sample(df: DataFrame, value: str, side: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic between the rows with side true and false, and its asymptotic p."""
    n = df.agg(F.sum(F.col(side).cast("long")).alias("na"), F.sum((~F.col(side)).cast("long")).alias("nb"))
    steps = df.groupBy(value).agg(F.sum(F.col(side).cast("long")).alias("a"), F.sum((~F.col(side)).cast("long")).alias("b"))
    upto = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct length
    gap = steps.select(F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb")).crossJoin(F.broadcast(n)).select(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb")).alias("d"), "na", "nb")
    stat = gap.groupBy("na", "nb").agg(F.max("d").alias("statistic"))
    lam = F.col("statistic") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    series = sum((2 * (-1) ** (k - 1) * F.exp(-2 * k * k * lam * lam) for k in range(1, 40)), F.lit(0.0))
    return stat.select("na", "nb", "statistic", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(lam < 0.2, 1.0).otherwise(series))).alias("p_value"))


def js_divergence(df: DataFrame, vector: str, side: str) -> DataFrame:
    """Jensen-Shannon divergence, in nats, of the softmax of two groups' centroids."""
    c = centroid(df, vector, side)
    wide = c.groupBy("pos").agg(F.max(F.when(F.col(side), F.col("mean"))).alias("a"), F.max(F.when(~F.col(side), F.col("mean"))).alias("b"))
    z = wide.agg(F.sum(F.exp("a")).alias("za"), F.sum(F.exp("b")).alias("zb"))
    p = wide.crossJoin(F.broadcast(z)).select((F.exp("a") / F.col("za")).alias("p"), (F.exp("b") / F.col("zb")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    return p.agg((0.5 * F.sum(F.col("p") * F.log(F.col("p") / m)) + 0.5 * F.sum(F.col("q") * F.log(F.col("q") / m))).alias("js"))
