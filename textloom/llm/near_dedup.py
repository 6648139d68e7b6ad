"""Near duplicates by one-permutation MinHash with optimal densification.

Texts of one shingle set are one node.  Nodes meet in banded buckets; each bucket links its members
to one center, so candidate pairs grow with the members, not with their square.  Links are
confirmed on full shingle sets.  A star misses a link between two members that the center is not
like; so the buckets whose members are still in several components are compared block by block
inside tasks, which emit nothing but links.  With 64 bands of 8 rows a pair of similarity 0.85
meets in no bucket with a chance of about 1e-9 (0.8: 1e-5).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import minhash as M
from textloom.llm.common import fresh, gather, in_worker, map_batches, materialise, row_key, slices, unique_ids, write_few
from textloom.llm.components import components

BLOCK = 256  # members of a bucket that one task compares with as many
FAN = 1024  # links of one center that one row of it serves
COLUMNS = 4096  # distinct shingles compared at once


def _prints(src: DataFrame) -> DataFrame:
    def start():
        seen = M.WordHashes()

        def step(columns):
            ids, texts = columns
            n, keys, buckets = [], [], []
            for t in texts:
                sh = M.shingles(t, seen)
                n.append(len(sh))
                keys.append(xxhash.xxh3_128_digest(sh.tobytes()) if len(sh) else None)
                buckets.append(M.bands(sh).view(np.int64) if len(sh) else None)
            return [ids, n, keys, buckets]

        return step

    return map_batches(src, start, "id long, n long, set_key binary, bands array<long>")


def _sets(src: DataFrame) -> DataFrame:
    """The sets of nodes: src has node, set_key and the text of every row with the node's id."""

    def start():
        seen = M.WordHashes()

        def step(columns):
            nodes, keys, texts = columns
            found = [M.shingles(t, seen).tobytes() for t in texts]
            own = [xxhash.xxh3_128_digest(s) == k for s, k in zip(found, keys, strict=True)]  # an id may have other texts
            return [[x for x, o in zip(nodes, own, strict=True) if o], [s for s, o in zip(found, own, strict=True) if o]]

        return step

    return map_batches(src, start, "id long, sh binary").dropDuplicates(["id"])


def _verify(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) that hold on full sets; a center's set is repeated once per FAN links."""
    fan = edges.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("parts"))
    spread = edges.join(fan, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    left = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.withColumnsRenamed({"id": "a", "sh": "sa"}), "a")
    pairs = spread.join(sets.withColumnsRenamed({"id": "b", "sh": "sb"}), "b").join(left, ["a", "part"]).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = [M.similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(in_worker(run), "a long, b long").distinct()


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, a slice of the shingles at a time."""
    every = np.unique(np.concatenate([*left, *right]))
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for k in range(0, len(every), COLUMNS):
        part = every[k : k + COLUMNS]

        def grid(sets):
            g = np.zeros((len(sets), len(part)), dtype=np.float32)
            for row, s in zip(g, sets, strict=True):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                row[np.searchsorted(part, own)] = 1
            return g

        a = grid(left)
        out += a @ (a if right is left else grid(right)).T
    return out


def _block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Pairs of one block pair that are in different components and like enough.

    rows: (side, id, label, n, hashes); sides 0 and 1 are compared, side 2 with itself.
    """
    found = []
    for one, two in ([0, 1],) if rows[0][0] < 2 else ([2, 2],):
        left, right = [r for r in rows if r[0] == one], [r for r in rows if r[0] == two]
        if not left or not right:
            continue
        a = [r[4] for r in left]
        inter = _shared(a, a if one == two else [r[4] for r in right]) + 2  # hashes cut to 32 bits may meet in one set
        na, nb = np.array([r[3] for r in left]), np.array([r[3] for r in right])
        other = np.array([r[2] for r in left])[:, None] != np.array([r[2] for r in right])[None, :]
        hit = other & (inter * 100 >= percent * (na[:, None] + nb[None, :] - inter))
        found += [(min(left[i][1], right[j][1]), max(left[i][1], right[j][1])) for i, j in np.argwhere(hit)]
    return found


def _rest(open_rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs across components inside buckets: open_rows has h, id, label, n, sh, size."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (
        open_rows.withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "h",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"),
            "id",
            "label",
            "n",
            "sh",
        )
    )
    together = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def out():
            links = list(dict.fromkeys(_block_links(rows, percent))) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in slices(batches):
            h, i, j, side, ids, label, n = (batch.column(k).to_pylist() for k in range(7))
            for k, sh in enumerate(batch.column(7)):
                if (h[k], i[k], j[k]) != key:
                    yield out()
                    key, rows = (h[k], i[k], j[k]), []
                rows.append((side[k], ids[k], label[k], n[k], np.frombuffer(sh.as_py(), np.uint32)))
        yield out()

    return together.mapInArrow(in_worker(run), "a long, b long").distinct()


def _narrow(sets: DataFrame) -> DataFrame:
    """Sets as sorted 32-bit hashes: enough to find candidates, half the bytes to move."""

    def start():
        return lambda columns: [columns[0], [np.unique((np.frombuffer(s, np.uint64) >> np.uint64(32)).astype(np.uint32)).tobytes() for s in columns[1]]]

    return map_batches(sets, start, "id long, sh binary")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Texts are linked if 100 * |common shingles| >= percent * |all their shingles|; component_id is
    the smallest id reachable by links, and kept says that it is the row's own.  Null, empty and
    blank texts have no shingles and no links.  Repeated rows of one id and text share its
    component; rows that share an id but no text are judged each by its own text.  A row without id
    takes part in no link, has no component and is not kept.  An empty table gives no rows; other
    columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = materialise(gather(_prints(src)), "prints")
    # copies of one set are one node; the set says the bands
    sets_of = prints.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialise(gather(sets_of).withColumn("id", F.monotonically_increasing_id()), "sets")
    nodes = reps.select("id", F.explode("bands").alias("h"))
    crowded = write_few(nodes.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"), "crowded")
    members = write_few(nodes.join(crowded, "h"), "members")
    # the center of a bucket is the member with the most company over all buckets
    company = members.groupBy("id").agg(F.sum("size").alias("company"))
    centers = members.join(company, "id").groupBy("h").agg(F.max(F.struct("company", (-F.col("id")).alias("x"))).alias("top")).select("h", (-F.col("top.x")).alias("a"))
    edges = write_few(members.join(centers, "h").where("id <> a").select("a", F.col("id").alias("b")).distinct(), "edges")
    wanted = reps.join(members.select("id").distinct(), "id").select(F.col("id").alias("node"), "set_key", F.col("doc").alias("id"))
    sets = materialise(_sets(src.join(wanted, "id").select("node", "set_key", "text")), "shingles")
    links = write_few(_verify(edges, sets, percent), "links")
    labels = components(links)

    named = members.join(labels, "id", "left").select("h", "id", "size", F.coalesce("label", "id").alias("label"))
    prints_of = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    split = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), *prints_of).where("lo <> hi")
    split = split.groupBy("n", "x0", "x1").agg(F.min("h").alias("h")).select("h")  # buckets of the same members: one of them
    rest = write_few(named.join(split, "h", "left_semi"), "open")
    if not rest.isEmpty():
        sized = rest.join(reps.select("id", "n"), "id").join(_narrow(sets.join(rest.select("id").distinct(), "id", "left_semi")), "id")
        more = write_few(_verify(write_few(_rest(sized, percent), "candidates"), sets, percent), "links")
        if not more.isEmpty():
            labels = components(links.unionByName(more))

    least = labels.join(reps.select("id", "doc"), "id").groupBy("label").agg(F.min("doc").alias("root"))
    named = reps.select("set_key", "id", "doc").join(labels, "id", "left").join(least, "label", "left")
    roots = materialise(gather(named.select("set_key", F.coalesce("root", "doc").alias("root"))), "roots")
    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return prints.select("id", "n", "set_key").join(roots, "set_key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        root.alias("component_id"),
        F.coalesce(root == F.col("id"), F.lit(False)).alias("kept"),
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """docs with one row for each component of near_groups, all columns as they were.

    It is the row of the smallest id; where ids are shared or missing, rows are numbered by id, those without one
    last, and then by a hash of all their values, so that every text is a node of its own.  Null, empty and blank
    texts are like nothing and stay; an empty table gives no rows.
    """
    key = fresh(docs, "id")
    if unique_ids(docs, id_col):
        rows = docs.withColumn(key, F.col(id_col).cast("long"))
    else:
        name = fresh(docs, "key")
        keyed = docs.withColumn(name, row_key(docs, text_col)).dropDuplicates([name])
        order = keyed.select(F.col(id_col).cast("long").alias("id"), name).orderBy(F.col("id").asc_nulls_last(), name)
        numbers = materialise(order.select(name, F.monotonically_increasing_id().alias(key)), "numbers")
        rows = materialise(keyed.join(numbers, name).drop(name), "numbered")
    gone = near_groups(rows.select(key, text_col), key, text_col, percent).where("not kept").select(key)
    return rows.join(write_few(gone, "gone"), key, "left_anti").drop(key)
