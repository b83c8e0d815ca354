"""Nearest neighbours in a hierarchical k-means tree, best bins first.

The tree is fitted on a bounded sample; every vector is indexed in its leaf.  A
query walks the tree through a priority queue of node distances, which orders
the leaves; it visits as many as a calibration asks for: the visits widen until
the recall of calibration queries, measured against brute force over all
vectors, reaches the target.  A query whose leaves hold too few vectors for a
whole answer goes on through its queue until they do.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalharm.llm.common import stored
from signalharm.llm.repeats import spread

K = 10
BRANCHES = 8
#: Vectors of a leaf, about, and leaves at most: a visit leaves k rows, so these bound a query's rows.
LEAF_ROWS = 1024
LEAVES = 1024
#: The tree is fitted on at most about this many vectors, 8 or more for each leaf.
SAMPLE = 20_000
TARGET = 0.94
#: Calibration queries at most; each is compared with every vector.
CALIBRATION = 256
#: Members of a leaf that one task group compares.
CHUNK_ROWS = 4096


class Tree:
    """Centres in one array; children of a node are a range of nodes; leaves have numbers."""

    def __init__(self, sample: np.ndarray, leaf_rows: float, branches: int = BRANCHES, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [sample.mean(axis=0) if len(sample) else np.zeros(1)], [(0, 0)], [-1]
        self.leaves, work = 0, [(0, sample)]
        while work:
            node, own = work.pop()
            groups = self._split(own, branches, rng) if len(own) > max(leaf_rows, 8) else []
            if len(groups) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            begin = len(self.centres)
            self.children[node] = (begin, begin + len(groups))
            for part in groups:
                work.append((len(self.centres), part))
                self.centres.append(part.mean(axis=0))
                self.children.append((0, 0))
                self.leaf.append(-1)
        self.centres = np.array(self.centres)

    @staticmethod
    def _split(own: np.ndarray, branches: int, rng) -> list[np.ndarray]:
        centres = own[rng.choice(len(own), min(branches, len(own)), replace=False)]
        for _ in range(8):
            near = np.argmin(_squares(own, centres), axis=1)
            centres = np.array([own[near == j].mean(axis=0) for j in range(len(centres)) if (near == j).any()])
        near = np.argmin(_squares(own, centres), axis=1)
        return [own[near == j] for j in range(len(centres)) if (near == j).any()]

    def home(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest child at every node."""
        node = np.zeros(len(x), np.int64)
        open_ = {0: np.arange(len(x))}
        while open_:
            n, rows = open_.popitem()
            a, b = self.children[n]
            if a == b:
                node[rows] = self.leaf[n]
                continue
            near = a + np.argmin(_squares(x[rows], self.centres[a:b]), axis=1)
            for child in np.unique(near):
                open_[int(child)] = rows[near == child]
        return node

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first walk, and more until they hold ``need`` ids (``held``: ids of each leaf)."""
        out, queue, n = [], [(0.0, 0)], 0
        while queue and (len(out) < most or n < need):
            node = heapq.heappop(queue)[1]
            a, b = self.children[node]
            if a == b:
                out.append(self.leaf[node])
                n += 0 if held is None else held[self.leaf[node]]
                continue
            for j, d in enumerate(_squares(q[None], self.centres[a:b])[0].tolist()):
                heapq.heappush(queue, (d, a + j))
        return out


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c**2).sum(axis=1)[None]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) == 0:
        return np.zeros((0, 1))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part: finite, not zero, of one dimension."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    own = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    return own.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 and 0.0 are one value


def _top(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        return near[np.lexsort((ids[near], d[near]))[:k]]
    return np.lexsort((ids, d))[:k]


def nearest(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    k: int = K,
    leaf_rows: int = LEAF_ROWS,
    sample: int = SAMPLE,
    target: float = TARGET,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each row whose id is divisible by ``every``.

    Nearness is Euclidean distance in double precision, ties to the smaller id.
    Null, zero and non-finite vectors and null ids take no part, nor do vectors
    of another dimension than most.  Repeated rows of one id and vector count
    once; equal vectors of several ids are one point of the index with its
    k + 1 smallest ids, which are all that an answer can hold.
    """
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(rows.where(F.size("v") == sizes.dim).select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "vectors")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = rows.dropDuplicates(["vec_id", "v"]).withColumn("place", place).where(F.col("place") <= k + 1)
    points = stored(points.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")

    n = points.count()
    picked = points.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(min(1.0, sample / n) * (1 << 20)) + 1)
    fitted = np.array([r.v for r in picked.select("v").limit(2 * sample).collect()])
    tree = Tree(fitted[np.lexsort(fitted.T)], max(leaf_rows, n / LEAVES) * len(fitted) / n)

    def housed(batches):
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                leaf = pa.array(tree.home(_vectors(part.column("v"))))
                yield pa.RecordBatch.from_arrays([leaf, part.column("v"), part.column("ids")], ["leaf", "v", "ids"])

    members = stored(points.mapInArrow(housed, "leaf long, v array<double>, ids array<long>"), "members")
    asked = rows.where(F.col("vec_id") % every == 0)
    asked = stored(asked.select("vec_id", "v").distinct(), "queries")
    queries = asked.select("v").distinct()
    most = _calibrated(members, queries, tree, k, target, calibration)

    counts = members.groupBy("leaf").agg(  # a row a leaf
        F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"), F.sum(F.size("ids")).alias("ids")
    )
    counts = stored(counts, "leaf-chunks")
    held = np.zeros(tree.leaves, np.int64)
    for r in counts.collect():
        held[r.leaf] = r.ids
    counts = counts.drop("ids")
    members = members.join(F.broadcast(counts), "leaf").select(
        "leaf", F.pmod(F.xxhash64("v"), "chunks").cast("int").alias("chunk"), "v", "ids"
    )

    def visiting(batches):
        for batch in batches:
            v = _vectors(batch.column("v"))
            leaves = [tree.visits(q, most, held, k + 1) for q in v]  # a query finds itself, too
            at = np.repeat(np.arange(len(v)), [len(x) for x in leaves])
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for xs in leaves for x in xs], pa.int64()), batch.column("v").take(pa.array(at))], ["leaf", "q"]
            )

    again = counts.withColumnsRenamed({"leaf": "to_leaf", "chunks": "to_chunks"})
    visits = queries.mapInArrow(visiting, "leaf long, q array<double>").join(F.broadcast(again), F.col("leaf") == F.col("to_leaf"))
    visits = visits.select("leaf", F.explode(F.sequence(F.lit(0), F.col("to_chunks") - 1)).alias("chunk"), "q")

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q, ids = _vectors(left.column("v")), _vectors(right.column("q")), left.column("ids").to_pylist()
        held = np.array([len(i) for i in ids], np.int64)
        flat, begin = np.array([i for own in ids for i in own], np.int64), np.cumsum(held) - held
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(0, len(q) if len(x) else 0, 256):
            block = q[i : i + 256]
            rough = _squares(block, x)
            # exact distances for all that may be among the nearest, whatever the rough ones' rounding
            slack = 1e-9 * ((x**2).sum(axis=1).max() + (block**2).sum(axis=1))
            m = min(k + 1, len(x)) - 1
            at, member = np.nonzero(rough <= (np.partition(rough, m, axis=1)[:, m] + slack)[:, None])
            d = np.sqrt(((x[member] - block[at]) ** 2).sum(axis=1))
            n = held[member]
            at, d, vec = np.repeat(at, n), np.repeat(d, n), flat[spread(begin[member], n)]
            order = np.lexsort((vec, d, at))
            at, d, vec = at[order], d[order], vec[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            parts.append(tuple(y[place <= k] for y in (at + i, vec, d)))
        at, vec, d = (np.concatenate(y) for y in zip(*parts))
        return pa.table({"q": right.column("q").combine_chunks().take(pa.array(at)), "vec_id": vec, "score": d})

    group = ["leaf", "chunk"]
    near = members.groupBy(*group).cogroup(visits.groupBy(*group)).applyInArrow(compared, "q array<double>, vec_id long, score double")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")
    out = asked.withColumnRenamed("vec_id", "query_id").join(near, F.col("v") == F.col("q")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "v").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(points: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """q (number of the query), vec_id, score, leaf: exact nearest points of a bounded set of queries."""

    def run(batches):
        best = {j: (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for j in range(len(queries))}
        for batch in batches:
            x, first = _vectors(batch.column("v")), np.array([i[0] for i in batch.column("ids").to_pylist()], np.int64)
            leaf = batch.column("leaf").to_numpy()
            for j, q in enumerate(queries if len(x) else ()):
                ids, d, home = best[j]
                ids, d, home = np.append(ids, first), np.append(d, _distances(x, q)), np.append(home, leaf)
                top = _top(ids, d, k)
                best[j] = ids[top], d[top], home[top]
        for j, (ids, d, home) in best.items():
            yield pa.RecordBatch.from_pydict({"q": [j] * len(ids), "vec_id": ids, "score": d, "leaf": home})

    found = points.mapInArrow(run, "q long, vec_id long, score double, leaf long")
    place = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _calibrated(members: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float, calibration: int) -> int:
    """Leaf visits at which the calibration queries' recall reaches the target."""
    picked = queries.orderBy(F.xxhash64("v"), "v").limit(calibration).collect()
    if not picked:
        return 1
    q = np.array([r.v for r in picked])
    order = [{leaf: i for i, leaf in enumerate(tree.visits(x, tree.leaves))} for x in q]
    # a query's own point is found first; it counts neither here nor there
    ranks = np.array([order[r.q][r.leaf] for r in brute_force(members, q, k + 1).collect() if r.score > 0])
    most = 1
    while most < tree.leaves and len(ranks) and (ranks < most).mean() < target:
        most = min(tree.leaves, most + max(1, most // 8))
    return most
