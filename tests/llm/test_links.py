"""SimHash components, nearest neighbours, connected components."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from signalharm.llm import graph, neighbours, simhash
from tests.llm import cases


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("shard_rows, sample", [(2000, 20000), (4, 30)])
def test_simhash_components(spark, shard_rows, sample):
    rng, data = random.Random(8), cases.rows()
    base = cases.sentence(rng, 400)
    for i in range(60):
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(400)] = "zz"
        data.append((200 + i, " ".join(words), *data[0][2:]))
    got = simhash.near_duplicates(cases.documents(spark, data), shard_rows=shard_rows, sample=sample).collect()
    assert len(got) == len(data)
    fps = np.array([slow_fingerprint(r[1] or "") for r in data], np.uint64)
    group = np.arange(len(data))
    for i in range(len(data)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 2):
            group[group == group[j]] = group[i]
    want = sorted(
        (-1 if r[0] is None else r[0], f"{int(f):016x}", min((data[j][0] for j in np.flatnonzero(group == g) if data[j][0] is not None), default=None))
        for r, f, g in zip(data, fps, group)
    )
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(64)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def vectors(spark, n=900, seed=2):
    rng = np.random.default_rng(seed)
    data = [(i, rng.normal(size=8).tolist(), "x") for i in range(n)]
    data += [(n + i, data[0][1], "x") for i in range(300)]  # a common vector: a quarter of the rows
    data += [(5000, None, "x"), (5100, [0.0] * 8, "x"), (5200, [float("nan")] + [1.0] * 7, "x"), (5300, [None] + [1.0] * 7, "x")]
    data += [(5400, [float("inf")] + [1.0] * 7, "x"), (5500, [1.0, 2.0], "x"), (None, [1.0] * 8, "x"), data[100], data[100]]
    schema = T.StructType(
        [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("leaf", T.StringType())]
    )
    return data, spark.createDataFrame(data, schema)


def test_nearest(spark):
    data, df = vectors(spark)
    got = neighbours.nearest(df, leaf_rows=16, sample=500).collect()
    good = {i: np.array(v) for i, v, _ in data if i is not None and i < 5000}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    hit = total = 0
    for q in (i for i in ids if i % 100 == 0):
        d = np.sqrt(((x - good[q]) ** 2).sum(axis=1))
        want = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11))
        assert all(abs(r.score - np.linalg.norm(good[r.vec_id] - good[q])) < 1e-12 for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hit, total = hit + len({r.vec_id for r in own} & set(want)), total + 10
    assert hit / total >= 0.9
    assert len(got) == total


def test_nearest_of_few(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])], schema)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(df).collect())
    assert got == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert neighbours.nearest(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0])], schema)).count() == 0


def test_far_queries_get_whole_answers(spark):
    """Small far groups have leaves of their own: their queries go on until they have k neighbours."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(16, 8)) * 5
    data = [(i + 1 if (i + 1) % 100 else 10_000_001 + i, (centres[i % 16] + rng.normal(size=8) * 0.05).tolist()) for i in range(4000)]
    data += [(100 * (j + 1), (np.eye(8)[j] * 10_000).tolist()) for j in range(4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, leaf_rows=32, sample=4000).collect()
    for j in range(4):
        own = sorted((r.rank, r.vec_id) for r in got if r.query_id == 100 * (j + 1))
        assert [r for r, _ in own] == list(range(1, 11)) and len({i for _, i in own}) == 10
