"""Exact largest inner products by columnar branch-and-bound.

Vectors become whole numbers and are stored vertically: a tile holds one matrix
per block of dimensions, the dimensions of largest mass first, and the norms of
what remains after each block.  A tile of queries meets a tile of candidates;
scores grow block by block, and a pair survives while its score and the product
of its remaining norms can still reach the query's threshold: the k-th best
score over a bounded set of candidates, and later the k-th best of the tile.
Once few pairs survive they are compacted into index lists.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalharm.llm.common import stored

K = 20
EVERY = 20
SCALE = 64.0
#: Dimensions of a block.
BLOCK = 8
#: Rows of a tile, about; a pair of tiles is one group.  Smaller tables are cut into LEAST_TILES tiles of SMALL_TILE rows or more.
TILE_ROWS, SMALL_TILE, LEAST_TILES = 65_536, 2048, 12
#: Candidates whose scores give each query its first threshold.
SEEDS = 4096
#: Queries and candidates that a dense step holds at once.
QUERY_STEP, CANDIDATE_STEP = 64, 8192
#: Below this share of a dense step, survivors are compacted into lists.
COMPACT = 0.05


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id, v (floor of ``scale`` times each component) of the vectors that take part, each row once."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    return own.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(scale)))).distinct()


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), dim)


class Tile:
    """Rows in vertical layout: one dimension-major matrix per block, and the norms of what remains."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, block: int):
        self.ids = ids
        columns = np.ascontiguousarray(rows[:, order].T)
        self.peak = float(np.abs(columns.astype(np.float64)).max(initial=0.0))
        self.blocks = [columns[i : i + block] for i in range(0, len(order), block)]
        mass = [(b.astype(np.float64) ** 2).sum(axis=0) for b in self.blocks]
        rest = np.cumsum(mass[::-1], axis=0)[::-1] if mass else np.zeros((0, len(ids)))
        # after the last block nothing remains; sums of squares are rounded up a little
        self.rest = np.sqrt(np.concatenate([rest[1:], np.zeros((1, len(ids)))]) * (1 + 1e-9)) if mass else rest

    def exact_in_doubles(self, other: "Tile") -> bool:
        return self.peak * other.peak * max(1, sum(map(len, self.blocks))) < 2.0**52


def search(queries: Tile, candidates: Tile, tau: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query rows, candidate ids, scores, pairs that were scored to the end): each query's k best of the tile, none below ``tau``."""
    kind = np.float64 if queries.exact_in_doubles(candidates) else np.int64
    left, right = [b.astype(kind) for b in queries.blocks], [b.astype(kind) for b in candidates.blocks]
    tau, parts, ended = tau.copy(), [], 0
    for a in range(0, len(queries.ids), QUERY_STEP):
        q = slice(a, min(a + QUERY_STEP, len(queries.ids)))
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind))
        for c in range(0, len(candidates.ids), CANDIDATE_STEP):
            s = slice(c, min(c + CANDIDATE_STEP, len(candidates.ids)))
            at, member, score = _descend(left, right, queries, candidates, q, s, tau[q])
            ended += len(at)
            other = queries.ids[q][at] != candidates.ids[s][member]
            found = tuple(np.concatenate(x) for x in zip(held, (at[other], member[other] + c, score[other])))
            held = _best(*found, candidates.ids, k)
            n = np.bincount(held[0], minlength=q.stop - a)
            full = np.flatnonzero(n >= k)  # k are known: nothing below the k-th can matter
            if len(full) and kind is np.float64:
                last = np.cumsum(n)[full] - 1
                tau[q][full] = np.maximum(tau[q][full], held[2][last])
        parts.append((held[0] + a, candidates.ids[held[1]], held[2].astype(np.int64)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return *(np.concatenate(x) for x in zip(*parts)), ended


def _descend(left, right, queries: Tile, candidates: Tile, q: slice, s: slice, tau: np.ndarray):
    """Surviving (query, candidate, score) of one dense step, block by block."""
    n_q, n_c = q.stop - q.start, s.stop - s.start
    score, pairs = np.zeros((n_q, n_c), left[0].dtype if left else np.float64), None
    for i, (x, y) in enumerate(zip(left, right)):
        q_rest, c_rest = queries.rest[i][q], candidates.rest[i][s]
        if pairs is None:
            score += x[:, q].T @ y[:, s]
            alive = score + q_rest[:, None] * c_rest >= tau[:, None]
            if i + 1 == len(left) or np.count_nonzero(alive) < COMPACT * alive.size:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            at, member = pairs
            for u, v in zip(x[:, q], y[:, s]):
                score += u[at] * v[member]
            alive = score + q_rest[at] * c_rest[member] >= tau[at]
            pairs, score = (at[alive], member[alive]), score[alive]
        if pairs is not None and len(pairs[0]) == 0:
            break
    if pairs is None:  # vectors without dimensions: every score is 0
        pairs = np.nonzero(score >= tau[:, None])
        score = score[pairs]
    return *pairs, score


def _best(at: np.ndarray, member: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The k best of each query, best first, ties to the smaller id."""
    order = np.lexsort((ids[member], -score, at))
    at, member, score = at[order], member[order], score[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], member[keep], score[keep]


def thresholds(ids: np.ndarray, rows: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score over the seed candidates other than itself; minus infinity if they are fewer."""
    if len(seeds) < k:
        return np.full(len(rows), -np.inf)
    peak = float(np.abs(rows.astype(np.float64)).max(initial=0.0)) * float(np.abs(seeds.astype(np.float64)).max(initial=0.0))
    if peak * max(1, rows.shape[1]) >= 2.0**52:  # scores beyond doubles: no threshold
        return np.full(len(rows), -np.inf)
    score = rows.astype(np.float64) @ seeds.T.astype(np.float64)
    score[ids[:, None] == seed_ids[None]] = -np.inf
    return np.partition(score, len(seeds) - k, axis=1)[:, len(seeds) - k]


def tile_count(n: int, tile_rows: int) -> int:
    return max(-(-n // tile_rows), min(LEAST_TILES, -(-n // SMALL_TILE)), 1)


def top_scores(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = EVERY,
    k: int = K,
    scale: float = SCALE,
    block: int = BLOCK,
    tile_rows: int = TILE_ROWS,
    seeds: int = SEEDS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by ``every``.

    Components are floored after multiplication by ``scale``; scores are whole
    numbers, ties go to the smaller id, and a query's own id is no candidate.
    Null and non-finite vectors and null ids take no part, nor do vectors of
    another dimension than most.  Repeated rows of one id and vector count once.
    Other columns are not read.  Scores are exact while they fit 64 bits.

    Each group is one tile of queries and one of candidates; both sides' tiles
    have a bounded size, whatever the vectors: copies are dealt by their ids.
    """
    spark = vectors.sparkSession
    rows = whole(vectors, id_col, vector_col, scale)
    size = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = size["dim"]
    rows = stored(rows.where(F.size("v") == dim), "whole-vectors")
    n, n_queries = rows.count(), rows.where(F.col("vec_id") % every == 0).count()

    def masses(batches):
        total = np.zeros(dim)
        for batch in batches:
            total += (matrix(batch.column("v"), dim).astype(np.float64) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"d": np.arange(dim), "mass": total})

    mass = np.zeros(dim)
    for r in rows.mapInArrow(masses, "d long, mass double").groupBy("d").agg(F.sum("mass").alias("mass")).collect():  # a row a dimension
        mass[r.d] = r.mass
    order = np.argsort(-mass, kind="stable")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(seeds).collect()  # at most ``seeds`` rows
    seed_ids = np.array([r.vec_id for r in picked], np.int64)
    seed_rows = np.array([r.v for r in picked], np.int64).reshape(len(picked), dim)

    def started(batches):
        for batch in batches:
            ids, v = batch.column("vec_id").to_numpy(), matrix(batch.column("v"), dim)
            for i in range(0, len(batch), 1024):
                tau = thresholds(ids[i : i + 1024], v[i : i + 1024], seed_ids, seed_rows, k)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1024).columns, pa.array(tau)], ["vec_id", "v", "tau"])

    queries = rows.where(F.col("vec_id") % every == 0).mapInArrow(started, "vec_id long, v array<long>, tau double")
    c_tiles, q_tiles = tile_count(n, tile_rows), tile_count(n_queries, tile_rows)
    deal = F.xxhash64("vec_id", "v")
    # every query tile meets every candidate tile: each side's rows go once to each tile of the other
    left = rows.select(F.pmod(deal, F.lit(c_tiles)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1))).alias("q"), "vec_id", "v")
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(c_tiles - 1))).alias("c"), F.pmod(deal, F.lit(q_tiles)).alias("q"), "vec_id", "v", "tau"
    )
    left, right = (x.withColumns({"c": F.col("c").cast("int"), "q": F.col("q").cast("int")}) for x in (left, right))

    def met(c: pa.Table, q: pa.Table) -> pa.Table:
        c_tile, q_tile = (Tile(t.column("vec_id").to_numpy(), matrix(t.column("v"), dim), order, block) for t in (c, q))
        at, ids, score, _ = search(q_tile, c_tile, q.column("tau").to_numpy().copy(), k)
        # a query's vector tells rows of one id apart
        own = q.column("v").combine_chunks().take(pa.array(at)) if len(q) else pa.array([], pa.list_(pa.int64()))
        return pa.table({"query_id": q_tile.ids[at], "v": own, "vec_id": ids, "score": score})

    ddl = "query_id long, v array<long>, vec_id long, score long"
    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(met, ddl)
    place = Window.partitionBy("query_id", "v").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
