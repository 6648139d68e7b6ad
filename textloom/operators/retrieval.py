"""Lexical, dense and fused retrieval, and ranking metrics.

Many queries run at once: every result carries its query_id.  Postings are a table, so an index is
built once and read by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.batches import slices
from textloom.functions import vectors as vx
from textloom.operators.members import member_sets
from textloom.storage import materialise

K1, B, RRF = 1.2, 0.75, 60
ASKED, ASKED_BYTES = 10_000, 64 << 20  # queries that are broadcast at once, and the size of their vectors
CELLS = 1 << 22  # scores computed at once
BLOCK, BLOCK_TERMS = 4096, 2_000_000  # queries of words that are broadcast at once, and their words
BUCKETS = 1 << 20  # classes of members by which their frequency is told
NO_ID = (1 << 63) - 1  # stands for null
FREQUENT, RARE = 1024, 0.01  # terms of a block that are multiplied as a matrix, each in more than this share of the pairs
ROWS, ROW_BYTES = 4096, 16 << 20  # texts whose words are looked up at once, and their bytes
CELL_BYTES = 32 << 20  # sets that are compared with each other in one task's memory; with those of another block, twice as much
MARKS = 1 << 23  # classes of ids by which sets without a pair are left where they are


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, length): lower-cased words of two or more word characters."""
    words = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9_]+)"), 1), lambda w: F.length(w) >= 2)
    rows = df.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return rows.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))


def lengths(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: the number of texts and their mean length in words."""
    n = F.size(F.filter(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9_]+)"), 1), lambda w: F.length(w) >= 2))
    return df.agg(F.count("*").alias("n_docs"), F.avg(n).alias("mean_length"))


def bm25(queries: DataFrame, index: DataFrame, size: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Top k texts of each query (query_id, term): query_id, id, score in [0, 1), rank.

    With digits, scores are rounded before the best are taken, so that equal ones are ties on any engine.

    size is one row; terms of the queries are looked up before anything is weighed, so postings of
    other terms are only filtered out.
    """
    hits = index.join(queries.select("term").distinct(), "term", "left_semi")
    rows = materialise(_grouped(hits), "postings")
    n, mean = size.select(F.col("n_docs").cast("double"), F.col("mean_length").cast("double")).first()
    return _lexical(queries, rows, k, digits, (n, mean))


def bm25_texts(queries: DataFrame, df: DataFrame, id_col: str, text_col: str, k: int, digits: int | None = None) -> DataFrame:
    """bm25() over the texts themselves: no postings are made, moved or written; rows of one id are one text of several parts."""
    ids = df.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n"))
    if not ids.where("n > 1 or id is null").isEmpty():
        return bm25(queries, postings(df, id_col, text_col), lengths(df, id_col, text_col), k, digits)
    words = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9_]+)"), 1), lambda w: F.length(w) >= 2)
    return _lexical(queries, df.select(F.col(id_col).cast("long").alias("id"), words.alias("terms")), k, digits, None)


def _grouped(index: DataFrame) -> DataFrame:
    """Postings as a row an id: its terms with their tf and length."""
    entry = F.collect_list(F.struct("term", F.col("tf").cast("double").alias("tf"), F.col("length").cast("double").alias("length"))).alias("e")
    return index.groupBy(F.col("id").cast("long").alias("id")).agg(entry).select("id", *[F.col(f"e.{c}").alias(x) for c, x in (("term", "terms"), ("tf", "tf"), ("length", "length"))])


def _entries(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, number of the term, tf and length of a batch's known terms."""
    lists = batch.column(1)
    own = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, known = np.repeat(np.arange(len(own)), own), term >= 0
    if batch.num_columns > 2:
        tf, length = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
        return row[known], term[known], tf[known], length[known]
    key, tf = np.unique(row[known] * len(vocabulary) + term[known], return_counts=True)
    row, term = np.divmod(key, max(1, len(vocabulary)))
    return row, term, tf.astype(float), own[row].astype(float)


def _lexical(queries: DataFrame, rows: DataFrame, k: int, digits: int | None, size: tuple[float, float] | None) -> DataFrame:
    """The k best rows (id, terms or terms, tf, length) of each query, a block of queries at a time.

    A block is broadcast as a matrix of its frequent terms and lists of its rare ones; tasks multiply texts with it and
    keep k hits a query, so nothing is made for each pair.  The work is queries times texts.  Without a size, the rows
    hold all words and are counted.
    """
    spark = rows.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "term").where("term is not null").distinct()
    n_asked, pairs = asked.agg(F.countDistinct("query_id"), F.count("*")).first()
    blocks = max(1, -(-n_asked // BLOCK), -(-pairs // BLOCK_TERMS))
    if blocks > 1:
        asked = materialise(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    few = _few(rows)

    def hits(block: DataFrame) -> DataFrame:
        table = block.select("query_id", "term").toArrow()
        vocabulary = pc.unique(table.column("term"))
        term = pc.index_in(table.column("term"), value_set=vocabulary).to_numpy().astype(np.int64)
        ids, query = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
        words = spark.sparkContext.broadcast(vocabulary)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, seen = np.zeros(len(words.value), np.int64), np.zeros(3, np.int64)
            for batch in slices(batches, ROWS, ROW_BYTES):
                df += np.bincount(_entries(batch, words.value)[1], minlength=len(df))
                seen += (batch.num_rows, batch.num_rows - batch.column(1).null_count, len(batch.column(1).flatten()))
            at = np.nonzero(df)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2, -3]])), pa.array(np.concatenate([df[at], seen]))], names=["term", "n"])

        counted = dict(few.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
        n, mean = size or (counted.get(-1, 0), counted.get(-3, 0) / max(1, counted.get(-2, 0)))
        df = np.array([counted.get(t, 0) for t in range(len(vocabulary))], float)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        # frequent terms are multiplied, rare ones looked up: what is in more than a hundredth of the pairs, if it is among the first
        share = df / max(1, n) * np.bincount(term, minlength=len(df)) / max(1, len(ids))
        order = np.argsort(-share, kind="stable")[:FREQUENT]
        column = np.full(len(df), -1)
        column[order[share[order] > RARE]] = np.arange((share[order] > RARE).sum())
        matrix = np.zeros(((column >= 0).sum(), len(ids)), np.uint8)
        often = column[term] >= 0
        matrix[column[term[often]], query[often]] = 1
        by_term = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by_term], np.arange(len(df) + 1))
        sent = spark.sparkContext.broadcast((ids, idf, column, matrix, first, query[by_term].astype(np.int32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, idf, column, matrix, first, asking = sent.value
            best, often = Best(len(ids), k), matrix.astype(float)
            step = max(1, CELLS // 4 // max(1, len(ids)))
            for batch in slices(batches, ROWS, ROW_BYTES):
                row, term, tf, length = _entries(batch, words.value)
                w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                own = pc.fill_null(batch.column(0), NO_ID).to_numpy(zero_copy_only=False)
                ends = np.searchsorted(row, np.arange(0, len(own) + step, step))
                for at, lo, hi in zip(range(0, len(own), step), ends[:-1], ends[1:], strict=True):
                    s = _products(row[lo:hi] - at, term[lo:hi], w[lo:hi], min(step, len(own) - at), column, often, first, asking)
                    score = np.where(s > 0, s / (1 + s), -np.inf)
                    best.add((score if digits is None else np.round(score, digits)).T, own[at : at + step])
            yield best.rows(ids)

        return materialise(top_k(few.mapInArrow(run, "query_id long, id long, score double"), k), "hits")  # plans read them more than once

    if blocks == 1:
        return hits(asked)
    return reduce(DataFrame.unionByName, [hits(asked.where(F.col("block") == b)) for b in range(blocks)])


def _products(row: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, column: np.ndarray, often: np.ndarray, first: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """Sums of the weights w of each of n rows' terms that a query has: n by queries."""
    at = column[term]
    dense = np.zeros((n, len(often)))
    np.add.at(dense, (row[at >= 0], at[at >= 0]), w[at >= 0])
    s = dense @ often
    row, term, w = row[at < 0], term[at < 0], w[at < 0]
    lists = first[term + 1] - first[term]
    done = np.cumsum(lists)
    lo = 0
    while lo < len(row):  # CELLS products at once, or one list
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + CELLS, side="right")))
        size = lists[lo:hi]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[term[lo:hi]], size)
        s += np.bincount(np.repeat(row[lo:hi], size) * s.shape[1] + asking[place], np.repeat(w[lo:hi], size), s.size).reshape(s.shape)
        lo = hi
    return s


class Best:
    """The k best ids of each of n queries by score, ties to the smaller id, whatever number of rows goes by."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), NO_ID)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        """score: queries by rows of ids; what is not finite is no hit."""
        least = self.score[:, -1]
        hit = (score >= least[:, None]) & np.isfinite(score)
        if score.shape[1] > self.k and np.count_nonzero(hit) > 4 * hit.shape[0] * self.k:
            with np.errstate(invalid="ignore"):
                least = np.maximum(least, np.partition(np.where(np.isfinite(score), score, -np.inf), -self.k, axis=1)[:, -self.k])
            hit &= score >= least[:, None]
        at, of = np.nonzero(hit)
        if not len(at):
            return
        mine, k = np.unique(at), self.k
        q = np.concatenate([np.repeat(mine, k), at])
        s = np.concatenate([self.score[mine].ravel(), score[at, of]])
        i = np.concatenate([self.id[mine].ravel(), ids[of]])
        order = np.lexsort((i, -s, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[place < k]
        self.score[mine], self.id[mine] = s[order].reshape(-1, k), i[order].reshape(-1, k)

    def rows(self, ids: np.ndarray) -> pa.RecordBatch:
        at, of = np.nonzero(np.isfinite(self.score))
        own = self.id[at, of]
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(own, mask=own == NO_ID), pa.array(self.score[at, of] + 0.0)], names=["query_id", "id", "score"])


def _few(df: DataFrame) -> DataFrame:
    """df in no more tasks than a few times the cluster's cores: each hands on k hits a query."""
    return df.coalesce(4 * max(16, df.sparkSession.sparkContext.defaultParallelism))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best ids of each query, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense(queries: DataFrame, vectors: DataFrame, k: int, pool: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Exact cosine search of queries (query_id, q) in vectors (id, embedding), a block of queries at a time.

    A block's vectors are broadcast, about ASKED queries and ASKED_BYTES at most; every Arrow batch is multiplied with
    them at once, and a task hands on its k best of each query.  A zero vector is at no distance from
    any; null vectors take no part; digits as in bm25.
    """
    asked = queries.where(F.col("q").isNotNull())
    dim = asked.agg(F.max(F.size("q"))).first()[0] or 1
    n = asked.count()
    blocks = max(1, -(-n // ASKED), -(-n * dim * 8 // ASKED_BYTES))
    v = (vectors if pool is None else vectors.join(pool, "id", "left_semi")).where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    few = _few(v)

    def hits(block: DataFrame) -> DataFrame:
        rows = block.select(F.col("query_id").cast("long"), F.col("q").cast("array<double>")).collect()
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        sent = v.sparkSession.sparkContext.broadcast((ids, _unit(np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best, step = Best(len(ids), k), max(1, CELLS // max(1, len(ids)))
            for part in (b.slice(i, step) for b in batches for i in range(0, b.num_rows if len(ids) else 0, step)):
                own = part.column(0).to_numpy()
                m = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1))
                s = q @ m.T
                s[(q == 0).all(axis=1)] = 1.0
                s[:, (m == 0).all(axis=1)] = 1.0
                best.add(s if digits is None else np.round(s, digits), own)
            yield best.rows(ids)

        return materialise(top_k(few.mapInArrow(run, "query_id long, id long, score double"), k), "hits")

    if blocks == 1:
        return hits(asked)
    dealt = materialise(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    parts = [hits(dealt.where(F.col("block") == b).drop("block")) for b in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size == 0, 1.0, size)


def fuse_ranks(*lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, id, rank)."""
    every = lists[0].select("query_id", "id", "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "id", "rank"))
    return every.groupBy("query_id", "id").agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))


def blend(dense_hits: DataFrame, lexical_hits: DataFrame, alpha: float) -> DataFrame:
    """alpha of the dense and 1 - alpha of the lexical score, each scaled to [0, 1] per query."""
    w = Window.partitionBy("query_id")
    scaled = lambda df, name: df.select("query_id", "id", vx.min_max(F.col("score"), w).alias(name))
    j = scaled(dense_hits, "a").join(scaled(lexical_hits, "b"), ["query_id", "id"], "full")
    return j.select("query_id", "id", (alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))).alias("score"))


def boost(hits: DataFrame, tokens: str, name: str, is_definition: str, factor: float = 1.5) -> DataFrame:
    """Definitions whose name the query says count `factor` times."""
    hit = F.col(is_definition) & F.array_contains(tokens, F.lower(name))
    return hits.withColumn("score", F.when(hit, F.col("score") * factor).otherwise(F.col("score")))


def metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """nDCG@k, MRR@k and recall@k per query of gold (query_id, id, grade); a query without hits scores 0."""
    good = gold.where("grade > 0")
    cut = ranked.where(F.col("rank") <= k).join(good, ["query_id", "id"])
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    got = cut.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.min("rank").alias("first"), F.countDistinct("id").alias("found"))
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    best = good.withColumn("r", F.row_number().over(w)).groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r")))).alias("idcg"), F.count("*").alias("wanted"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return best.join(got, "query_id", "left").select("query_id", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("found") / F.col("wanted")).alias("recall"))


def labelled_metrics(ranked: DataFrame, queries: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """metrics() where every member (id, label, grade) of a query's label (query_id, label) is good.

    Members are counted by label and grade, so that no row is made for each pair of a query and a member.
    """
    good = members.where("grade > 0 and label is not null")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    per_grade = good.groupBy("label", "grade").agg(F.count("*").alias("n")).groupBy("label").agg(F.sum("n").alias("wanted"), F.reverse(F.array_sort(F.collect_list(F.struct("grade", "n")))).alias("grades"))
    # the k best grades of a label, each as often as it occurs
    best = F.slice(F.flatten(F.transform("grades", lambda g: F.array_repeat(g["grade"], F.least(g["n"], F.lit(k)).cast("int")))), 1, k)
    ideal = F.aggregate(F.transform(best, lambda g, i: gain(g, i + 1)), F.lit(0.0), lambda a, x: a + x)
    ideals = per_grade.select("label", "wanted", ideal.alias("idcg"))
    hits = ranked.where(F.col("rank") <= k).select("query_id", "id", "rank").join(queries, "query_id").join(good, ["id", "label"])
    got = hits.groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.min("rank").alias("first"), F.countDistinct("id").alias("found"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return queries.join(ideals, "label").join(got, "query_id", "left").select("query_id", zero(F.col("dcg") / F.col("idcg")).alias("ndcg"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("found") / F.col("wanted")).alias("recall"))


def hydrate(hits: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """hits with source and labels of their documents; documents keep one row a hit."""
    named = labels.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))
    return hits.join(documents, "id", "left").join(named, "id", "left")


def class_terms(df: DataFrame, group: str, text_col: str, n: int) -> DataFrame:
    """Top n terms of each group by TF-IDF over groups, with smoothed idf and unit length."""
    words = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit("([a-z0-9_]+)"), 1), lambda w: F.length(w) >= 2)
    tf = df.select(group, F.explode(words).alias("term")).groupBy(group, "term").agg(F.count("*").alias("tf"))
    groups = df.agg(F.countDistinct(group).alias("groups"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df_, "term").join(F.broadcast(groups)).withColumn("x", F.col("tf") * (F.log((1.0 + F.col("groups")) / (1.0 + F.col("df"))) + 1))
    size = w.groupBy(group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    ranked = w.join(size, group).select(group, "term", (F.col("x") / F.col("size")).alias("weight"))
    top = Window.partitionBy(group).orderBy(F.desc(F.round("weight", 9)), F.asc("term"))
    return ranked.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= n)


def shingle_pairs(df: DataFrame, id_col: str, shingle_col: str, percent: int) -> DataFrame:
    """Pairs of ids whose sets have 100 * common >= percent * union: hashed_pairs() of the sets."""
    return hashed_pairs(member_sets(df, id_col, shingle_col), percent)


def hashed_pairs(sets: DataFrame, percent: int, only: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, similarity) of sets (id, n, h), a written table, by prefix filtering over 64-bit hashes of members;
    only of those whose id is in `only`, if given.

    A set of n members keeps only its n - ceil(percent * n / 100) + 1 first in an order of all members: two similar
    sets share one of those, so no similar pair is missed.  The order puts rare ones first, by counts of BUCKETS
    classes of hashes, so that frequent members are not joined on; any order is right.  Pairs are first held against
    sketches of an eighth of a byte to a quarter a member, so that sets are moved for few pairs but the similar ones.
    """
    few = _few(sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy() & (BUCKETS - 1), minlength=BUCKETS)
        at = np.nonzero(n)[0]
        for k in range(0, len(at), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(at[k : k + ROWS]), pa.array(n[at[k : k + ROWS]])], names=["bucket", "n"])

    found = few.select("h").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS, ROW_BYTES):
            own, g = pc.list_value_length(batch.column(1)).to_numpy(), batch.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(len(own)), own)
            order = np.lexsort((g, sent.value[g & (BUCKETS - 1)], row))
            most = own + (-own * percent) // 100 + 1
            kept = g[order][np.arange(len(g)) - np.repeat(np.cumsum(own) - own, own) < most[row]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), _cut(kept, most), _cut(*_sketches(row, g, own))], names=["id", "n", "p", "h"])

    kind = dict(sets.dtypes)["id"]
    prefix = sets.select("id", "h").mapInArrow(first, f"id {kind}, n int, p array<long>, h array<long>")
    prefix = materialise(prefix if only is None else prefix.join(only.select("id"), "id", "left_semi"), "prefixes")
    side = lambda c: prefix.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.posexplode("p").alias(f"i{c}", "g"))
    # what stands before the shared member in both, the member, and what stands behind it are all that they can share
    can = F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (can * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    near = materialise(side("a").join(side("b"), "g").where((F.col("a") < F.col("b")) & alike).select("a", "b").distinct(), "near")
    near = materialise(_in_cells(near, prefix.select("id", "h"), lambda own, others: _may_share(own, others, percent)).select("a", "b"), "nearer")
    return _in_cells(near, sets.select("id", "h"), lambda own, others: _share(own, others, percent))


def _cut(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def _sketches(row: np.ndarray, g: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members g of sets as bits that each member turns: a set's size and then its bits, one to two a member, as
    longs, and how many these are.  As a member turns one bit, two sets differ in no fewer members than bits."""
    words = 1 << np.ceil(np.log2(np.maximum(1, -(-own // 64)))).astype(np.int64)
    start = np.cumsum(words) - words
    bit = start[row] * 64 + ((g >> 24) & (words[row] * 64 - 1))
    bits = np.packbits((np.bincount(bit, minlength=words.sum() * 64) & 1).astype(bool)).view(np.int64)
    return np.insert(bits, start, own), words + 1


def _may_share(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """1 where the sketches of two sets leave it open whether 100 * common >= percent * union, else nothing (nan)."""
    found = np.full(len(others), np.nan)
    size = np.array([len(x) for x in others])
    n = own[0] + np.array([x[0] for x in others])
    for words in np.unique(size):
        at = np.nonzero(size == words)[0]
        least = min(words, len(own)) - 1
        many = _folded(np.stack([others[k][1:] for k in at]), least)
        differ = np.bitwise_count((many ^ _folded(own[None, 1:], least)).view(np.uint64)).sum(axis=1, dtype=np.int64)
        found[at[(n[at] - differ) * (100 + percent) >= 2 * percent * n[at]]] = 1.0
    return found


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _share(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """common / union of a sorted set with others where 100 * common >= percent * union, else nothing (nan)."""
    n, g = np.array([len(x) for x in others]), np.concatenate(others)
    hit = own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g
    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
    union = len(own) + n - both
    return np.where(both * 100 >= percent * union, both / union, np.nan)


def _in_cells(near: DataFrame, rows: DataFrame, measure: Callable[[np.ndarray, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """The pairs near (a, b) for whose rows (id, h) measure finds a similarity: a, b, similarity.

    A row isn't moved for each of its pairs: ids are dealt to blocks of about CELL_BYTES with what they are near to, and
    a row is sent once to each cell, that is two blocks or one, in which it has pairs.  Rows in no pair stay where they are.
    """
    spark, kind = near.sparkSession, dict(rows.dtypes)["id"]
    ends = near.select(F.col("a").alias("id"), "a").union(near.select("b", "a")).groupBy("id").agg(F.min("a").alias("label"))
    ends = materialise(ends, "ends")
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS))
    marks = np.zeros(MARKS, bool)
    marks[ends.select(mark.cast("long").alias("m")).distinct().toArrow().column("m").to_numpy()] = True
    sent = spark.sparkContext.broadcast(marks)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value[batch.column(2).to_numpy()])).select([0, 1])

    moved = rows.select("id", "h", mark.cast("long").alias("m")).mapInArrow(marked, f"id {kind}, h array<long>")
    parts = ends.join(rows.select("id", F.size("h").cast("long").alias("n")), "id").groupBy("label").agg(F.ceil(F.sum("n") * 8 / CELL_BYTES).alias("parts"))
    blocks = materialise(ends.join(parts, "label").select("id", F.xxhash64("label", F.pmod(F.xxhash64("id"), "parts")).alias("block")), "blocks")
    side = lambda c: blocks.withColumnsRenamed({"id": c, "block": f"b{c}"})
    cell = F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")).alias("cell")
    pairs = materialise(near.join(side("a"), "a").join(side("b"), "b").select(cell, "a", "b"), "cells")
    sites = pairs.select("cell", F.col("a").alias("id")).union(pairs.select("cell", "b")).distinct()
    members = sites.join(moved, "id").select("cell", F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), "h")
    dealt = members.union(pairs.select("cell", "a", "b", F.lit(None).cast("array<long>"))).repartition("cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        for batch in slices(batches, ROWS, ROW_BYTES):
            cells, a, b = (batch.column(k).to_pylist() for k in range(3))
            got, k = ([], [], []), 0
            while k < len(cells):
                if cells[k] != here:
                    here, held = cells[k], {}
                if b[k] is None:
                    held[a[k]] = batch.column(3)[k].values.to_numpy().copy()
                    k += 1
                    continue
                lo, size = k, 0  # the run of pairs of one a
                while k < len(cells) and cells[k] == here and a[k] == a[lo] and b[k] is not None and size < CELLS:
                    size += len(held[b[k]])
                    k += 1
                found = measure(held[a[lo]], [held[x] for x in b[lo:k]])
                at = np.nonzero(~np.isnan(found))[0]
                got[0].extend([a[lo]] * len(at))
                got[1].extend(b[lo + x] for x in at)
                got[2].extend(found[at])
            yield pa.RecordBatch.from_arrays([pa.array(got[0], batch.column(1).type), pa.array(got[1], batch.column(1).type), pa.array(got[2], pa.float64())], names=["a", "b", "similarity"])

    order = dealt.sortWithinPartitions("cell", F.col("b").isNotNull(), "a", "b")
    return order.mapInArrow(compare, f"a {kind}, b {kind}, similarity double")
