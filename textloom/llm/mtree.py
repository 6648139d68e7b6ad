"""Exact top-k inner products by best-first search of M-trees.

An inner product becomes a distance by one more coordinate: with M the largest norm, x' = (x,
sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.  Vectors go to the region
of the nearest of a bounded number of pivots and there, in blocks of bounded size, into M-trees of
paged metric nodes.  Every query first searches one block of its own region; its k-th score then
rules out regions and pages whose covering radius keeps them below it.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, materialise

PAGE = 32  # entries of a node
TREE = 4096  # vectors of a tree, in the mean
BATCH = 1024  # queries that search one copy of a tree
MAX_DIM = 65_536
_SLACK = 1e-7  # of rounding in distances, relative to M

_HIT = "query_id long, vec_id long, score long"


def lift(v: np.ndarray, m2: float) -> np.ndarray:
    """Rows with the coordinate that makes all norms M."""
    last = np.sqrt(np.maximum(0.0, m2 - (v.astype(np.float64) ** 2).sum(axis=1)))
    return np.hstack((v.astype(np.float64), last[:, None]))


class MTree:
    """Nodes hold (pivots, distances to the node's own pivot, covering radii, children or rows)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m2: float):
        self.ids, self.vectors, self.m2 = ids, vectors, m2
        self.points = lift(vectors, m2)
        self.nodes: list[tuple] = []
        self.rng = np.random.default_rng(len(ids))
        self.root = self._build(np.arange(len(ids)), None)
        del self.points

    def _dist(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        if len(rows) <= PAGE:
            far = np.zeros(len(rows)) if parent is None else self._dist(rows, parent)
            self.nodes.append((None, far, None, rows))
            return len(self.nodes) - 1
        picks = self.rng.choice(rows, min(PAGE, -(-len(rows) // PAGE) + 1), replace=False)
        to = np.stack([self._dist(rows, self.points[p]) for p in picks])
        owner = to.argmin(axis=0)
        if np.bincount(owner).max() == len(rows):  # equal points: any even split will do
            owner = np.arange(len(rows)) % len(picks)
        pivots, far, radii, children = [], [], [], []
        for k, p in enumerate(picks):
            own = rows[owner == k]
            if len(own):
                pivots.append(self.points[p])
                far.append(0.0 if parent is None else float(np.sqrt(((self.points[p] - parent) ** 2).sum())))
                radii.append(to[k, owner == k].max())
                children.append(self._build(own, self.points[p]))
        self.nodes.append((np.stack(pivots), np.array(far), np.array(radii), children))
        return len(self.nodes) - 1

    def search(self, query_id: int, q: np.ndarray, k: int, bound: int | None) -> list[tuple[int, int]]:
        """The k best (score, id) but for the query's own, ties to small ids; none below bound is needed."""
        point = np.append(q.astype(np.float64), 0.0)
        q2, slack = float((point**2).sum()), _SLACK * (1 + np.sqrt(self.m2))
        best: list[tuple[int, int]] = []  # min-heap of (score, -id)

        def reach() -> float:
            """A point farther than this cannot be among the best."""
            least = best[0][0] if len(best) == k else bound
            return np.inf if least is None else np.sqrt(max(0.0, q2 + self.m2 - 2.0 * least)) + slack

        queue, far_queue = [(0.0, self.root, None)], reach()
        while queue:
            low, at, to_own = heapq.heappop(queue)
            if low > far_queue:
                break
            pivots, far, radii, below = self.nodes[at]
            # a stored distance to the node's pivot bounds an entry's distance without computing it
            gap = np.zeros(len(far)) if to_own is None else np.abs(to_own - far)
            if pivots is None:
                rows = below[gap <= far_queue]
                scores = self.vectors[rows] @ q
                least = best[0][0] if len(best) == k else bound
                if least is not None:
                    rows, scores = rows[scores >= least], scores[scores >= least]
                for s, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True):
                    if i != query_id:
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                far_queue = reach()
            else:
                near = np.flatnonzero(gap - radii <= far_queue)
                to = np.sqrt(((pivots[near] - point) ** 2).sum(axis=1))
                for n, d in zip(near, to, strict=True):
                    if (least := max(0.0, d - radii[n])) <= far_queue:
                        heapq.heappush(queue, (least, below[n], d))
        return [(s, -i) for s, i in best]


def _wide(columns: list, dim: int) -> np.ndarray:
    out = np.zeros((len(columns), dim), dtype=np.int64)
    for row, v in zip(out, columns, strict=True):
        row[: len(v)] = v
    return out


def _search(queries: DataFrame, trees: DataFrame, k: int, dim: int) -> DataFrame:
    """queries (region, block, id, v, bound) through the trees of their blocks, BATCH at a time."""
    sizes = queries.groupBy("region", "block").agg(F.ceil(F.count("*") / BATCH).cast("int").alias("parts"))
    dealt = queries.join(sizes, ["region", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    copies = trees.join(sizes, ["region", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    key = ["region", "block", "part"]

    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        hits = []
        if len(t) and len(q):
            tree = pickle.loads(t["tree"].iloc[0])
            for i, v, b in zip(q["id"], q["v"], q["bound"], strict=True):
                hits += [(i, x, s) for s, x in tree.search(i, _wide([v], dim)[0], k, None if pd.isna(b) else int(b))]
        return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"]).astype("int64")

    return dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(run, _HIT)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, pivots: int = 128, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors of greatest inner product for each query: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); scores are exact integers, ties go to the smaller id, a row
    with the query's own id is no candidate.  Rows without id, null vectors and those holding null
    or non-finite components take no part; a shorter vector counts as padded with zeros.  Repeated
    candidate rows count as often as they occur, a repeated query id is asked once.  `pivots` bounds
    the sample that divides the space; every vector is indexed.
    """
    spark = vectors.sparkSession
    v = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    clean = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    data = materialise(clean(vectors), "vectors")
    asked = clean(queries).dropDuplicates(["id"])
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double"))
    dim, m2 = data.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm2), F.lit(0.0))).first()
    if dim > MAX_DIM:
        raise ValueError(f"more than {MAX_DIM} components")
    seeds = [r["v"] for r in data.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    if not seeds:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centers = lift(_wide(seeds, dim), m2)  # at most `pivots` rows

    def placing():
        def step(columns):
            near, far = [], []
            points = lift(_wide(columns[1], dim), m2)
            for k in range(0, len(points), 1024):
                part = points[k : k + 1024]
                d2 = (part**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2 * part @ centers.T
                best = d2.argmin(axis=1)
                near += best.tolist()
                far += np.sqrt(((part - centers[best]) ** 2).sum(axis=1)).tolist()
            return [*columns, near, far]

        return step

    placed = materialise(map_batches(data, placing, "id long, v array<long>, region int, far double"), "placed")
    facts = {r[0]: (-(-r[1] // TREE), r[2]) for r in placed.groupBy("region").agg(F.count("*"), F.max("far")).collect()}  # a row per pivot
    blocks = F.create_map(*[F.lit(x) for r, (n, _) in facts.items() for x in (r, n)])[F.col("region")]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(rows["id"].to_numpy(np.int64), _wide(list(rows["v"]), dim), m2)
        return pd.DataFrame([[rows["region"].iloc[0], rows["block"].iloc[0], pickle.dumps(tree, 5)]], columns=["region", "block", "tree"])

    blocked = placed.select("id", "v", "region", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    trees = materialise(blocked.groupBy("region", "block").applyInPandas(build, "region int, block int, tree binary"), "trees")

    def home():
        def step(columns):
            points = np.hstack((_wide(columns[1], dim), np.zeros((len(columns[0]), 1))))
            near = [int(((centers - p) ** 2).sum(axis=1).argmin()) for p in points]
            near = [r if r in facts else next(iter(facts)) for r in near]
            return [near, [i % facts[r][0] for i, r in zip(columns[0], near, strict=True)], *columns, [None] * len(near)]

        return step

    route = "region int, block int, id long, v array<long>, bound long"
    first = materialise(map_batches(asked, home, route), "routes")
    early = materialise(_search(first, trees, k, dim), "hits")
    full = early.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("least")).alias("least"))
    again = first.drop("bound").join(full, "id", "left").select("id", "v", "least", F.col("region").alias("r0"), F.col("block").alias("b0"))

    def others():
        def step(columns):
            out = [[] for _ in range(5)]
            for i, v, least, r0, b0 in zip(*columns, strict=True):
                p = np.append(_wide([v], dim)[0], 0.0)
                to = np.sqrt(((centers - p) ** 2).sum(axis=1))
                reach = np.inf if least is None else np.sqrt(max(0.0, float(p @ p) + m2 - 2.0 * least)) + _SLACK * (1 + np.sqrt(m2))
                for r, (n, radius) in facts.items():
                    if to[r] - radius <= reach:
                        for b in range(n):
                            if (r, b) != (r0, b0):
                                for column, x in zip(out, (r, b, i, v, least), strict=True):
                                    column.append(x)
            return out

        return step

    late = _search(materialise(map_batches(again, others, route), "routes"), trees, k, dim)
    return _best(early.unionByName(late), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

