"""Judge scores, route comparisons, leaderboards, storage and fleet plans, the learned reranker, topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.storage import materialise

JUDGED = ["faithfulness", "answer_relevance", "context_precision", "context_recall"]
FEATURES = ["score", "is_lexical", "query_len"]
BLOCK = 2048  # vectors that are kept in one row
STRIP = 256  # vectors whose distances to a block are made at once
TILES = 8  # parts that the vectors are compared in, at least; each vector is moved once for each
TILE_BYTES = 64 << 20  # of vectors in a part, as one task holds two
FAN = 8  # forests that one task merges
_EDGE = np.dtype([("w", "<f8"), ("a", "<i8"), ("b", "<i8")])


def mock_judge(prompt: Column) -> list[Column]:
    """Four scores in [0, 1] from the first eight bytes of the prompt's SHA-256."""
    h = F.sha2(prompt, 256)
    return [(F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("double") / 65535.0).alias(name) for k, name in enumerate(JUDGED)]


def route_comparison(df: DataFrame, route: str, score: str, left: str = "cache", right: str = "retrieve") -> DataFrame:
    """One row: how many took each route, the mean score of each and their difference (null if one is empty)."""
    n = lambda x: F.count(F.when(F.col(route) == x, 1))
    mean = lambda x: F.avg(F.when(F.col(route) == x, F.col(score)))
    return df.agg(n(left).alias("n_left"), n(right).alias("n_right"), mean(left).alias("mean_left"), mean(right).alias("mean_right"), (mean(left) - mean(right)).alias("delta"))


def leaderboard(df: DataFrame, name: str, metric: str) -> DataFrame:
    """Names by descending metric, then name; the table has one row a name."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc(metric), F.asc(name))))


def fleet_plan(lanes: DataFrame, rates: DataFrame) -> DataFrame:
    """The fastest host of each lane's model (ties to the smaller name) and the seconds to drain its backlog.

    lanes: lane, model_key, backlog; rates: model_key, host, rate.  A lane without a usable rate has nulls.
    """
    good = rates.where(F.col("host").isNotNull() & (F.col("rate") > 0))
    w = Window.partitionBy("model_key").orderBy(F.desc("rate"), F.asc("host"))
    best = good.withColumn("nr", F.row_number().over(w)).where("nr = 1").select("model_key", "host", "rate")
    return lanes.join(best, "model_key", "left").select("lane", "model_key", "backlog", F.col("host").alias("recommended_host"), "rate", (F.col("backlog") / F.col("rate")).alias("drain_seconds"))


def storage_estimate(files: DataFrame, kind: str, size: str, chunk_chars: int = 1500, dim: int = 384) -> DataFrame:
    """Files, bytes, chunks and vector bytes of each kind, by the closed form of one vector a chunk."""
    chunks = F.ceil(F.col(size) / chunk_chars)
    return files.groupBy(kind).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.sum(chunks).cast("long").alias("chunks"), (F.sum(chunks) * 4 * dim).cast("long").alias("vector_bytes"))


def rerank_examples(events: DataFrame) -> DataFrame:
    """Features and label of feedback (signal, value, source, query): a value of more than 0.5 or a thumb up is
    good, a value below it or a thumb down bad, and the first that applies counts; the rest are left out."""
    value = F.coalesce(F.col("value"), F.lit(0.5))
    good = (F.col("signal") == "thumbs_up") | F.coalesce(F.col("value") > 0.5, F.lit(False))
    bad = (F.col("signal") == "thumbs_down") | F.coalesce(F.col("value") < 0.5, F.lit(False))
    label = F.when(good, 1).when(bad, 0)
    return events.select(value.cast("double").alias("score"), (F.col("source") == "lexical").cast("double").alias("is_lexical"), F.length("query").cast("double").alias("query_len"), label.alias("label")).where("label is not null")


def train_reranker(examples: DataFrame):
    """A logistic model over FEATURES and its AUC on the same rows (null if only one label occurs)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    n, good = examples.agg(F.count("*"), F.sum("label")).first()
    if not n:
        raise ValueError("no labelled feedback to train on")
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), LogisticRegression(maxIter=100)]).fit(examples)
    auc = BinaryClassificationEvaluator().evaluate(model.transform(examples)) if 0 < good < n else None
    return model, auc


def apply_reranker(model, hits: DataFrame, n: int) -> DataFrame:
    """hits (query_id, id, FEATURES) by the model's probability, then the old score, then id; the first n stay."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(hits).withColumn("new_score", vector_to_array("probability")[1])
    w = Window.partitionBy("query_id").orderBy(F.desc("new_score"), F.desc("score"), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "id", "new_score", "rank")


def density_topics(x: np.ndarray, least: int = 5) -> np.ndarray:
    """HDBSCAN labels (-1 noise): minimum spanning tree of mutual reachability, condensed by excess of mass."""
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T))
    core = np.sort(d, axis=1)[:, min(least, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = (reach[at] < best) & ~inside
        best[closer], link[closer] = reach[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[at], link[at], at))
    return _condensed(n, sorted(edges), least)


def _condensed(n: int, edges: list[tuple], least: int) -> np.ndarray:
    """Labels from the spanning tree's edges (weight, a, b) by rising weight."""
    parent, size, left = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), {}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, (w, a, b) in enumerate(edges):
        a, b = find(a), find(b)
        parent[a] = parent[b] = n + k
        size[n + k], left[n + k] = size[a] + size[b], (a, b, 1 / max(w, 1e-12))

    def leaves(k):
        stack, out = [k], []
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += left[k][:2]
        return out

    # condensed tree: a cluster lives from its birth until it splits into two of at least `least`
    root = 2 * n - 2
    born, stable, kids, order = {root: 0.0}, {root: 0.0}, {root: []}, [root]
    stack = [(root, root)]
    while stack:
        node, own = stack.pop()
        if node < n:
            continue
        a, b, lam = left[node]
        big = [c for c in (a, b) if size[c] >= least]
        if len(big) == 2:
            stable[own] += (lam - born[own]) * size[node]
            for c in big:
                born[c], stable[c], kids[c] = lam, 0.0, []
                kids[own].append(c)
                order.append(c)
                stack.append((c, c))
        else:
            stable[own] += (lam - born[own]) * sum(size[c] for c in (a, b) if size[c] < least)
            stack += [(c, own) for c in big]
    chosen = {c: not kids[c] for c in order}
    for c in reversed(order):
        if kids[c]:
            under = sum(stable[k] for k in kids[c])
            if c != root and stable[c] >= under:
                chosen[c] = True
            else:
                stable[c] = max(stable[c], under) if c != root else under
    labels, k, stack = np.full(n, -1), 0, [root]
    while stack:
        c = stack.pop()
        if chosen[c] and c != root:
            labels[leaves(c)] = k
            k += 1
        else:
            stack += kids[c]
    return labels


def topics(df: DataFrame, id_col: str, vector: str, by: str, least: int = 5, most: int = 20_000) -> DataFrame:
    """(by, id, topic): density clusters inside each group of at most `most` vectors, which one task holds."""
    if df.groupBy(by).count().where(F.col("count") > most).limit(1).count():
        raise ValueError(f"a group has more than {most} vectors: divide it first")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        return pd.DataFrame({"by": f["by"].to_numpy(), "id": f["id"].to_numpy(), "topic": density_topics(np.array(f["v"].tolist(), float), least)})

    rows = df.select(F.col(by).cast("long").alias("by"), F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.groupBy("by").applyInPandas(run, "by long, id long, topic long").withColumnsRenamed({"by": by, "id": id_col})


def _strips(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances of x and y by STRIP rows of x: (first row, distances, which the next ones overwrite)."""
    x, y = x.astype(float), y.astype(float)
    xx, yy, x = (x**2).sum(1), (y**2).sum(1), 2 * x
    room = np.empty((2, min(STRIP, len(x)), len(y)))
    for at in range(0, len(x), STRIP):
        d, product = room[:, : len(x) - at]
        np.add(xx[at : at + STRIP, None], yy[None], out=d)
        d -= np.matmul(x[at : at + STRIP], y.T, out=product)
        yield at, np.maximum(d, 0, out=d)


def _where(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(hit), hit.shape[1])


def _nearest(best: np.ndarray, d: np.ndarray, across: bool = False) -> np.ndarray:
    """The k smallest of each row of best and of d, or across of each column of d."""
    k = best.shape[1]
    if np.isinf(best).any():
        head, d = (d[:STRIP].T, d[STRIP:]) if across else (d[:, :STRIP], d[:, STRIP:])
        best = np.partition(np.hstack([best, head]), k - 1, axis=1)[:, :k]
    bound = best.max(1)
    hits = _where(d < (bound[None] if across else bound[:, None])) if d.size else ([], [])
    if not len(hits[0]):
        return best
    rows, owner = np.unique(hits[across], return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(rows)), k), owner])
    w = np.concatenate([best[rows].ravel(), d[hits]])
    order, best = np.lexsort((w, owner)), best.copy()
    best[rows] = w[order][np.searchsorted(owner[order], np.arange(len(rows)))[:, None] + np.arange(k)]
    return best


def _spanning(reach: np.ndarray, same: bool) -> list[tuple[float, int, int]]:
    """Minimum spanning tree of one block, or of the links between two: (weight, row, column)."""
    rows, n = len(reach), len(reach) if same else sum(reach.shape)
    open_, best, link = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        open_[at] = False
        best[at] = np.inf
        side = slice(0, n) if same else slice(rows, n) if at < rows else slice(0, rows)
        w = reach[at] if same or at < rows else reach[:, at - rows]
        closer = (w < best[side]) & open_[side]
        best[side][closer], link[side][closer] = w[closer], at
        at = int(best.argmin())
        edges.append((best[at], *sorted((int(link[at]), at))))
    return edges if same else [(w, a, b - rows) for w, a, b in edges]


def _forest(edges: np.ndarray) -> np.ndarray:
    """The minimum spanning forest of edges, by weight, then ends, rising."""
    edges = edges[np.lexsort((edges["b"], edges["a"], edges["w"]))]
    nodes, ends = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
    parent, keep = list(range(len(nodes))), []
    for k, (a, b) in enumerate(zip(ends[: len(edges)].tolist(), ends[len(edges) :].tolist(), strict=True)):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            keep.append(k)
    return edges[keep]


def _joins(tree: np.ndarray, n: int) -> np.ndarray:
    """The weight at which each of n nodes gets into the part with more than half of the tree's nodes.

    tree has rising weights.  At the larger weight of two nodes both are in that part, so they are connected.
    """
    parent, size, after, last = list(range(n)), [1] * n, [-1] * n, list(range(n))
    out, half = [np.inf] * n, (len(tree) + 1) / 2
    for w, a, b in tree.tolist():
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if size[a] + size[b] > half:
            for k in (k for k in (a, b) if size[k] <= half):
                while k >= 0:
                    out[k], k = w, after[k]
        if size[a] < size[b]:
            a, b = b, a
        parent[b], after[last[a]], last[a] = a, b, last[b]
        size[a] += size[b]
    return np.array(out)


def _links(left: list[tuple], right: list[tuple] | None = None) -> np.ndarray:
    """Minimum spanning tree of the links between the vectors of two lists of (vectors, core distances), or inside
    one; the ends are numbered through left, then right.

    A link no shorter than the larger of its ends' weights of joining what is kept closes a cycle as its longest,
    so only shorter ones are kept; where these are many, as between clusters of a size, the tree of the two blocks is.
    """
    blocks = left + (right or [])
    first = np.cumsum([0, *(len(c) for _, c in blocks)]).tolist()
    tree, new, join, inside = np.empty(0, _EDGE), [], np.full(first[-1], np.inf), set()

    def keep(w, a, b):
        new.append(np.empty(len(w), _EDGE))
        new[-1]["w"], new[-1]["a"], new[-1]["b"] = w, a, b

    for i, j in ((i, j) for i in range(len(left)) for j in range(i if right is None else len(left), len(blocks))):
        (x, cx), (y, cy) = blocks[i], blocks[j]
        rows, columns = slice(first[i], first[i + 1]), slice(first[j], first[j + 1])

        def reach(x=x, y=y, cx=cx, cy=cy):
            out = np.empty((len(x), len(y)))
            for at, d in _strips(x, y):
                out[at : at + STRIP] = np.maximum(np.sqrt(d, out=d), cx[at : at + STRIP, None], out=d)
            return np.maximum(out, cy, out=out)

        def whole(reach, i=i, j=j):
            keep(*np.array(_spanning(reach, i == j)).reshape(-1, 3).T + [[0], [first[i]], [first[j]]])

        if not inside:
            whole(reach())
            tree = _forest(new.pop())
            join = _joins(tree, first[-1]) if len(tree) else np.where(np.arange(first[-1]) == rows.start, 0, np.inf)
        else:
            if fresh := {i, j} - inside:
                # its vectors join by their shortest links to a block that has
                (x1, c1, old), (x2, c2, own) = ((x, cx, rows), (y, cy, columns))[:: 1 if fresh == {j} else -1]
                near, w = np.empty(len(x2), int), np.empty(len(x2))
                for at, d in _strips(x2, x1):
                    k = np.maximum(d, np.square(c1), out=d).argmin(1)
                    near[at : at + STRIP], w[at : at + STRIP] = k, np.maximum(np.sqrt(d[np.arange(len(k)), k]), c2[at : at + STRIP])
                w = np.maximum(w, c1[near])
                join[own] = np.maximum(w, join[old][near])
                keep(w, old.start + near, own.start + np.arange(len(w)))
            bound, left_over = (join[rows, None], join[None, columns]), 8 * (len(x) + len(y))
            far = [np.square(v) * (1 + 1e-9) for v in bound]
            found = []
            for at, d in _strips(x, y):
                hit = d < far[0][at : at + STRIP]
                hit |= d < far[1]
                a, b = _where(hit)
                left_over -= len(a)
                if left_over < 0:
                    break
                w = np.maximum(np.sqrt(d[a, b]), np.maximum(cx[at + a], cy[b]))
                short = w < np.maximum(bound[0][at + a, 0], bound[1][0, b])
                found.append((w[short], rows.start + at + a[short], columns.start + b[short]))
            if left_over < 0:
                whole(reach())
            else:
                for links in found:
                    keep(*links)
        inside |= {i, j}
        if sum(map(len, new)) > max(len(tree), 1 << 15):
            tree, new = _forest(np.concatenate([tree, *new])), []
            join = _joins(tree, first[-1])
    return _forest(np.concatenate([tree, *new]))


def _packed(kind: str) -> Callable:
    """Rows of (block, ids, vectors) with the vectors as bytes, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                x = row.column(2)[0].values.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.array([x], pa.binary())], names=["block", "ids", "x"])

    return run


def all_topics(df: DataFrame, id_col: str, vector: str, least: int = 5) -> DataFrame:
    """(id, topic): density clusters of all vectors as one set, the clusters of density_topics.

    Parts of the set meet in pairs: first for the core distances, then for the spanning tree of each
    pair's links, and trees are merged until one is left; a dropped link closes a cycle as its longest,
    so the last tree spans the whole set.  The work is quadratic; what is moved is each vector once for each
    part, whose number does not grow with the set until two parts are more than a task should hold.  A merging
    task and the driver hold three numbers a vector.  A vector that is null or not finite is noise.
    """
    spark, kind = df.sparkSession, "<f4" if dict(df.dtypes)[vector] == "array<float>" else "<f8"
    v = F.col(vector)
    good = F.coalesce(v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))
    src = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), good.alias("good"))
    n = src.where("good").count()
    noise = lambda rows: rows.select(F.col("id").alias(id_col), F.lit(-1).cast("long").alias("topic"))
    if n < 2 * least:
        return noise(src)
    count, near = -(-n // BLOCK), least + 1
    i64, raw = pa.int64(), pa.binary()
    dealt = src.where("good").groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(count)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    packed = dealt.select("block", "rows.id", "rows.v").mapInArrow(_packed(kind), "block long, ids array<long>, x binary")
    blocks = materialise(packed, "topic-blocks")
    kept = blocks.select("block", F.size("ids"), F.length("x")).collect()
    sizes, start, at = {b: k for b, k, _ in kept}, {}, 0
    for b in sorted(sizes):
        start[b], at = at, at + sizes[b]

    tiles = min(count, max(TILES, isqrt(6 * spark.sparkContext.defaultParallelism), -(-sum(k for *_, k in kept) // TILE_BYTES)))

    def paired(table: DataFrame):
        """The blocks of each two tiles, and of each one, as a group; a tile has the blocks of a remainder."""
        each = table.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"), F.expr(f"int(block % {tiles})").alias("tile"), *table.columns)
        pairs = each.select(F.expr(f"least(tile, other) * {tiles} + greatest(tile, other)").alias("pair"), *table.columns)
        return pairs.repartition(2 * tiles * (tiles + 1), "pair").groupBy("pair")

    def held(table: pa.Table) -> list[tuple]:
        """(block, vectors, and the core distances if there are any) by rising block."""
        x = [np.frombuffer(v.as_buffer(), kind).reshape(sizes[b], -1) for b, v in zip(table["block"].to_pylist(), table["x"], strict=True)]
        more = [[np.frombuffer(v.as_buffer()) for v in table["core"]]] if "core" in table.column_names else []
        return sorted(zip(table["block"].to_pylist(), x, *more, strict=True), key=lambda row: row[0])

    def closest(table: pa.Table) -> pa.Table:
        rows, (p, q) = held(table), divmod(table["pair"][0].as_py(), tiles)
        best = {b: np.full((sizes[b], near), np.inf) for b, _ in rows}
        for k, (i, x) in enumerate(rows):
            for j, y in rows[k:]:
                if p != q and i % tiles == j % tiles:
                    continue
                for at, d in _strips(x, y):
                    best[i][at : at + STRIP] = _nearest(best[i][at : at + STRIP], d)
                    if i != j:
                        best[j] = _nearest(best[j], d, across=True)
        return pa.table({"block": pa.array(list(best), i64), "near": pa.array([v.tobytes() for v in best.values()], raw)})

    def core(f: pd.DataFrame) -> pd.DataFrame:
        found = np.hstack([np.frombuffer(d).reshape(-1, near) for d in f["near"]])
        return pd.DataFrame({"block": f["block"].iloc[:1], "core": [np.sqrt(np.partition(found, near - 1, axis=1)[:, near - 1]).tobytes()]})

    def links(table: pa.Table) -> pa.Table:
        rows, pair = held(table), table["pair"][0].as_py()
        p, q = divmod(pair, tiles)
        left, right = ([row for row in rows if row[0] % tiles == t] for t in (p, q))
        edges = np.empty(0, _EDGE)
        if left and right:
            edges = _links([row[1:] for row in left], None if p == q else [row[1:] for row in right])
            number = np.concatenate([start[b] + np.arange(sizes[b]) for b, *_ in (left if p == q else left + right)])
            ends = np.sort(number[np.stack([edges["a"], edges["b"]])], axis=0)
            edges["a"], edges["b"] = ends
        return pa.table({"key": pa.array([pair], i64), "edges": pa.array([edges.tobytes()], raw)})

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        edges = _forest(np.concatenate([np.frombuffer(e, _EDGE) for e in f["edges"]]))
        return pd.DataFrame({"key": f["part"].iloc[:1], "edges": [edges.tobytes()]})

    near_rows = paired(blocks.select("block", "x")).applyInArrow(closest, "block long, near binary")
    cores = materialise(near_rows.groupBy("block").applyInPandas(core, "block long, core binary"), "topic-cores")
    trees = materialise(paired(blocks.select("block", "x").join(cores, "block")).applyInArrow(links, "key long, edges binary"), "topic-links")
    parts = tiles * tiles
    while parts > 1:
        trees = materialise(trees.select(F.expr(f"key div {FAN}").alias("part"), "edges").groupBy("part").applyInPandas(merged, "key long, edges binary"), "topic-trees")
        parts = -(-parts // FAN)
    tree = np.concatenate([np.frombuffer(r[0], _EDGE) for r in trees.select("edges").collect()])
    labels = _condensed(n, np.sort(tree, order=["w", "a", "b"]).tolist(), least)
    named = spark.createDataFrame([(b, labels[start[b] : start[b] + sizes[b]].tolist()) for b in sizes], "block long, topics array<long>")
    rows = blocks.select("block", "ids").join(named, "block").select(F.explode(F.arrays_zip("ids", "topics")).alias("r"))
    return rows.select(F.col("r.ids").alias(id_col), F.col("r.topics").alias("topic")).unionByName(noise(src.where("not good")))
