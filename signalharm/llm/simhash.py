"""SimHash near-duplicates, linked through a vantage-point tree over the cluster.

The tree is a complete binary tree of vantage points, fitted on a bounded sample
of the distinct fingerprints; at each node a fingerprint goes to the inner or
outer side by its Hamming distance to the vantage point.  A leaf is a shard.
By the triangle inequality, fingerprints within ``radius`` of q lie in the side
that q's distance plus or minus the radius reaches, so q visits only those
shards; inside a shard pairs are compared exactly.  A shard hands on a spanning
forest of its links, never all pairs.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalharm.llm.common import map_texts, stored
from signalharm.llm.graph import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints that a shard owns, about.
SHARD_ROWS = 2000
#: The tree is fitted on at most about this many fingerprints; every fingerprint is indexed.
SAMPLE = 20_000
#: Levels of the tree at most (its nodes travel with each task: 9 bytes a node).
MAX_LEVELS = 14
#: Comparisons held in memory at once.
BLOCK = 1 << 21
SHIFT = np.uint64(1 << 63)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 hashes (seed 42) of the word shingles."""
    words = text.encode().lower().split()  # both ASCII only on bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        begins = (ends - sizes)[: len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins, stops)]
    raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(raw), 1 << 15):
        set_ += np.unpackbits(raw[i : i + (1 << 15)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) per input row."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            return {"fp": [signed(fingerprint(t or "", shingle)) for t in part.column("text").to_pylist()]}

        return step

    return map_texts(docs, id_col, text_col, {"fp": "long"}, make)


def fit_tree(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree in heap order; a node without a sample sends all inward."""
    points, radii = np.zeros(2**levels, np.uint64), np.full(2**levels, 64, np.int8)
    parts = {1: sample}
    for node in range(1, 2**levels):
        own = parts.pop(node, sample[:0])
        if len(own) == 0:
            continue
        # of a few candidates, the point whose distances spread most prunes best
        tried = own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]
        far = np.bitwise_count(tried[:, None] ^ own[None, :4096])
        best = int(np.argmax(far.std(axis=1)))
        d = np.bitwise_count(tried[best] ^ own)
        points[node], radii[node] = tried[best], np.int8(np.median(d))
        inner = d <= radii[node]
        parts[2 * node], parts[2 * node + 1] = own[inner], own[~inner]
    return points, radii


def route(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, levels: int, radius: int):
    """(row, leaf, home) of every shard that a fingerprint owns a place in or has to visit."""
    row, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
    for _ in range(levels):
        d = np.bitwise_count(fps[row] ^ points[node]).astype(np.int16)
        mu = radii[node].astype(np.int16)
        inner, outer = d - radius <= mu, d + radius > mu
        at_home = d <= mu
        row, node, home = (
            np.concatenate([row[inner], row[outer]]),
            np.concatenate([2 * node[inner], 2 * node[outer] + 1]),
            np.concatenate([(home & at_home)[inner], (home & ~at_home)[outer]]),
        )
    return row, node, home


def forest(fps: np.ndarray, home: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between a shard's own fingerprints and all that visit it."""
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    own = np.flatnonzero(home)
    step = max(1, BLOCK // max(1, len(fps)))
    for k in range(0, len(own), step):
        near = np.bitwise_count(fps[own[k : k + step], None] ^ fps[None, :]) <= radius
        a, b = np.nonzero(near)
        a = own[k + a]
        keep = a != b
        pairs = np.unique(np.stack([parent[a[keep]], parent[b[keep]]], axis=1), axis=0)
        for x, y in pairs.tolist():
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    out = [(i, root(i)) for i in range(len(fps))]
    return [(i, r) for i, r in out if i != r]


def links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """a, b: a spanning set of the pairs of distinct fingerprints (column ``fp``) within ``radius`` bits."""
    n = distinct.count()
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    share = min(1.0, sample / max(1, n))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).limit(2 * sample)
    fitted = np.array(sorted(r.fp for r in picked.collect()), dtype=np.int64).view(np.uint64)
    points, radii = fit_tree(np.random.default_rng(SEED).permutation(fitted), levels)

    def dealt(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fps), 4096):
                part = fps[i : i + 4096]
                row, node, home = route(part, points, radii, levels, radius)
                yield pa.RecordBatch.from_pydict({"shard": node, "fp": part[row].view(np.int64), "home": home})

    def linked(shard: pa.Table) -> pa.Table:
        fps = shard.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fps)
        fps, home = fps[order], shard.column("home").to_numpy()[order]
        found = np.array(forest(fps, home, radius), dtype=np.int64).reshape(-1, 2)
        own = fps.view(np.int64)
        return pa.table({"a": own[found[:, 0]], "b": own[found[:, 1]]})

    shards = distinct.select("fp").mapInArrow(dealt, "shard long, fp long, home boolean")
    return shards.groupBy("shard").applyInArrow(linked, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, n_copies.

    ``component_id`` is the smallest id reachable over links; ``n_copies`` counts
    the rows of the same fingerprint.  Null, empty and blank texts have
    fingerprint zero and link like any other.  Null ids never become a
    component id unless a component has no other.  Repeated rows keep their
    rows.  Other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies")), "distinct-simhash")
    roots = components(links(distinct, radius, shard_rows, sample))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", "n_copies", F.coalesce("root", "fp").alias("root")
    )
    joined = stored(joined, "simhash-roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(least, "root").select("fp", "component_id", "n_copies")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies"
    )
