"""Resampling by blocks of draws or flips.

Bootstrap: a task holds the observations of some keys, sorted once, and the
weights of a block of draws as a matrix (draws x clusters).  Weights of the points
of all its draws are one gather and one segmented sum; the curves of a draw are
pooled by a stack.  Neither observations nor draws are multiplied by each other.

Sign flips: signs are bits of one digest per (cluster, 128 flips).  A task turns
a block of clusters and a range of flips into a sign matrix and leaves one row
of partial sums.
"""

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws of a block; cells (draws x observations) that a task holds at once.
DRAW_BLOCK, CELLS = 250, 4_000_000
#: Observations of a bucket of keys, about.
BUCKET_ROWS = 200_000
#: Flips of one range (a multiple of 128), clusters of one block.
FLIP_RANGE, CLUSTER_BLOCK = 8192, 2048
#: Clusters of one range of draws; slots that draw at once.
TARGETS, SLOTS = 8192, 256
BITS = 128  # signs of one digest


def explained(sw: np.ndarray, swy: np.ndarray) -> float:
    """Sum over the pools of the increasing fit of (weighted sum squared / weight); points without weight are left out."""
    weight, total = [], []
    for a, b in zip(sw.tolist(), swy.tolist()):
        if a > 0:
            while weight and total[-1] * a >= b * weight[-1]:
                a, b = a + weight.pop(), b + total.pop()
            weight.append(a)
            total.append(b)
    return sum(b * b / a for a, b in zip(weight, total))


def gap_of_draws(cluster: np.ndarray, part: np.ndarray, x: np.ndarray, y: np.ndarray, weights: np.ndarray, constant: float) -> np.ndarray:
    """AG of one key for each row of ``weights`` (draws x clusters); nan where the weighted outcome is constant.

    A draw whose centred sum of squares is within ``constant`` of its raw one
    counts as constant, one whose metric never moves has the gap 0.
    """
    out = np.full(len(weights), np.nan)
    scopes = [np.arange(len(x))] + [np.flatnonzero(part == p) for p in np.unique(part)]
    step = max(1, CELLS // max(1, len(x)))
    for i in range(0, len(weights), step):
        w = weights[i : i + step]
        own = w[:, cluster]
        n, total, square = own.sum(axis=1), own @ y, own @ (y * y)
        sst = square - total * total / np.where(n > 0, n, 1)
        sst = np.where(sst > constant * square, sst, 0.0)
        fits = np.zeros((len(scopes), len(w)))
        moves = np.zeros(len(w), bool)
        for s, rows in enumerate(scopes):
            rows = rows[np.argsort(x[rows], kind="stable")]
            starts = np.flatnonzero(np.append(True, np.diff(x[rows]) != 0)) if len(rows) else rows
            mine = own[:, rows]
            sw, swy = np.add.reduceat(mine, starts, axis=1), np.add.reduceat(mine * y[rows], starts, axis=1)
            if s == 0:
                moves = (sw > 0).sum(axis=1) > 1
            fits[s] = [explained(a, b) if ok else 0.0 for a, b, ok in zip(sw, swy, sst > 0)]
        # sum of squared errors = square - explained, so the raw squares cancel in the difference
        raw = (fits[1:].sum(axis=0) - fits[0]) / np.where(sst > 0, sst, 1)
        raw = np.where((raw < 0) & (raw >= -1e-12), 0.0, raw)
        out[i : i + step] = np.where(sst > 0, np.where(moves, raw, 0.0), np.nan)
    return out


def draw_statistics(obs: DataFrame, cluster_oc: DataFrame, draws: DataFrame, keys: list[str], resamples: int, rows: int, constant: float = 1e-13) -> DataFrame:
    """``keys, resample, ag, oc`` for every draw: curves refitted, OC a weighted mean of cluster OC.

    ``rows``: observations in all, which decides the layout.  ``ag`` is null in a
    draw without variation of the outcome.
    """
    blocks, buckets = -(-resamples // DRAW_BLOCK), max(1, -(-rows // BUCKET_ROWS))
    span = F.sequence(F.lit(0), F.lit(blocks - 1))
    own = obs.join(cluster_oc.select(*keys, "cluster_id", "oc"), [*keys, "cluster_id"], "left")
    own = own.select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"), F.explode(span).alias("_block"), *keys, "cluster_id", "perturbation_id", "x", "y", "oc"
    )
    drawn = draws.select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"),
        F.floor(F.col("resample") / DRAW_BLOCK).cast("int").alias("_block"),
        F.col("resample").cast("int").alias("resample"), F.col("cluster_id"), F.col("weight").cast("double").alias("weight"),
    )

    def fitted(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        clusters, at = np.unique(pd.concat([left["cluster_id"], right["cluster_id"]]).to_numpy(), return_inverse=True)
        names = np.sort(right["resample"].unique())
        weights = np.zeros((len(names), len(clusters)))
        np.add.at(weights, (np.searchsorted(names, right["resample"]), at[len(left) :]), right["weight"].to_numpy())
        left = left.assign(_c=at[: len(left)])
        parts = []
        for key, rows in left.groupby(keys, sort=False, dropna=False) if len(names) else ():
            cluster = rows["_c"].to_numpy()
            ag = gap_of_draws(cluster, rows["perturbation_id"].to_numpy(), rows["x"].to_numpy(), rows["y"].to_numpy(), weights, constant)
            first = rows.drop_duplicates("_c").dropna(subset=["oc"]).sort_values("_c")  # sums do not depend on the order of arrival
            w = weights[:, first["_c"].to_numpy()]
            n = w.sum(axis=1)
            oc = np.divide(w @ first["oc"].to_numpy(), n, out=np.full(len(n), np.nan), where=n > 0)
            parts.append(pd.DataFrame({**dict(zip(keys, key)), "resample": names, "ag": ag, "oc": oc}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in (*keys, "resample", "ag", "oc")})

    types = {f.name: f.dataType.simpleString() for f in obs.schema}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", resample int, ag double, oc double"
    group = ["_bucket", "_block"]
    out = own.groupBy(*group).cogroup(drawn.groupBy(*group)).applyInPandas(fitted, ddl)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("ag", "oc")})


def draw_indexes(seed: str, slots: np.ndarray, resamples: int, n: int) -> np.ndarray:
    """Index in [0, n) that each slot draws in each resample (slots x resamples): 52 bits of the digest of (seed, resample, slot)."""
    md5, heads = hashlib.md5, [f"{seed}|{r}|".encode() for r in range(resamples)]
    raw = b"".join([md5(head + tail).digest() for tail in (str(k).encode() for k in slots.tolist()) for head in heads])
    high = np.frombuffer(raw, ">u8")[::2] >> np.uint64(12)
    return np.floor(high.astype(np.float64) / 2.0**52 * n).astype(np.int64).reshape(len(slots), resamples)


def drawn_sums(values: DataFrame, ids: DataFrame, n: int, cluster: str, keys: list[str], columns: list[str], seed: str, resamples: int) -> DataFrame:
    """``keys, resample, columns.., _w``: sums of per-cluster values over the clusters drawn, and their number.

    ``ids``: cluster and its position ``_k`` below ``n``.  Draws are packed numbers
    (resample, position in a range of clusters); a range's values meet all its draws
    in one task.  Neither a draw nor a value is multiplied by the other side.
    """
    spark = values.sparkSession
    cores = spark.sparkContext.defaultParallelism
    span = min(TARGETS, max(64, -(-n // (2 * cores))))

    def made(batches):
        for batch in batches:
            every = batch.column(0).to_numpy()
            for i in range(0, len(every), SLOTS):
                at = draw_indexes(seed, every[i : i + SLOTS], resamples, n)
                code = (np.arange(resamples) * span + at % span).astype(np.int32).ravel()
                part = (at // span).ravel()
                order = np.argsort(part, kind="stable")
                part, code = part[order], code[order]
                cuts = np.flatnonzero(np.append(True, np.diff(part) != 0))
                packed = [code[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(code)))]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int64()), pa.array(packed, pa.binary())], ["_part", "packed"])

    drawn = spark.range(0, n, 1, min(n, max(2 * cores, n // TARGETS))).mapInArrow(made, "_part long, packed binary")
    own = values.join(ids, cluster).select(
        F.floor(F.col("_k") / span).alias("_own"), (F.col("_k") % span).cast("int").alias("_at"), *keys, *[F.col(c).cast("double").alias(c) for c in columns]
    )

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = np.zeros(resamples * span, np.int64)
        for packed in left.column("packed"):
            np.add(counts, np.bincount(np.frombuffer(packed.as_buffer(), np.int32), minlength=len(counts)), out=counts)
        weights = counts.reshape(resamples, span)
        # rows in a fixed order: sums do not depend on the order of arrival
        right = right.sort_by([("_at", "ascending"), *[(k, "ascending") for k in keys]])
        names = right.select(keys).to_pandas().groupby(keys, dropna=False, sort=False) if keys else None
        groups = list(names.indices.values()) if keys else [np.arange(right.num_rows)]
        at = right.column("_at").to_numpy()
        cols = [right.column(c).to_pandas().to_numpy(np.float64) for c in columns]
        valid = [np.asarray(right.column(c).is_valid()) for c in columns]
        first, out, drawn_rows = [], [[] for _ in range(2 * len(columns) + 2)], np.arange(resamples)
        for rows in groups if right.num_rows else ():
            w = weights[:, at[rows]]
            total = w.sum(axis=1)
            there = total > 0
            first.append(np.full(int(there.sum()), rows[0]))
            out[0].append(drawn_rows[there])
            out[1].append(total[there])
            wf = w.astype(np.float64)
            for i, (v, ok) in enumerate(zip(cols, valid)):
                out[2 + 2 * i].append((wf @ np.where(ok[rows], v[rows], 0.0))[there])
                out[3 + 2 * i].append((w @ ok[rows].astype(np.int64))[there])
        out = [np.concatenate(o) if o else np.zeros(0) for o in out]
        picked = right.select(keys).take(pa.array(np.concatenate(first) if first else np.zeros(0, np.int64))) if keys else pa.table({})
        arrays = [*picked.columns, pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int64))]
        for i in range(len(columns)):
            arrays += [pa.array(out[2 + 2 * i].astype(np.float64)), pa.array(out[3 + 2 * i].astype(np.int64))]
        return pa.table(arrays, names=[*keys, "resample", "_w", *[x for c in columns for x in (f"s_{c}", f"n_{c}")]])

    types = {f.name: f.dataType.simpleString() for f in values.schema}
    ddl = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "resample int", "_w long", *[f"`s_{c}` double, `n_{c}` long" for c in columns]])
    out = drawn.groupBy("_part").cogroup(own.groupBy("_own")).applyInArrow(summed, ddl)
    sums = [F.when(F.sum(f"n_{c}") > 0, F.sum(f"s_{c}")).alias(c) for c in columns]
    return out.groupBy(*keys, "resample").agg(*sums, F.sum("_w").alias("_w"))


def sign_bits(seed: str, clusters: list, first: int, n: int) -> np.ndarray:
    """Signs (-1 or 1) of flips ``first`` to ``first + n`` (multiples of 128) for each cluster: clusters x flips.

    Flip f takes bit f % 4 of hexadecimal digit f % 128 // 4 of the digest of (seed, f // 128, cluster).
    """
    raw = b"".join(hashlib.md5(f"{seed}|{k}|{c}".encode()).digest() for c in clusters for k in range(first // BITS, (first + n) // BITS))
    byte = np.frombuffer(raw, np.uint8)
    digits = np.stack([byte >> 4, byte & 15], axis=1).ravel()
    bits = (digits[:, None] >> np.arange(4, dtype=np.uint8)) & 1
    return 1 - 2 * bits.reshape(len(clusters), n).astype(np.int8)


def sign_sums(values: DataFrame, cluster: str, columns: list[str], seed: str, flips: int) -> DataFrame:
    """``first`` (flip), ``n`` (flips), ``sums`` (packed, one row of doubles per column): signed sums over all clusters.

    ``values`` has one row per cluster; a null adds nothing.
    """
    ranges = -(-flips // FLIP_RANGE)
    name = F.col(cluster).cast("string")
    own = values.select(
        F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("_range"),
        name.alias("_c"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, c in enumerate(columns)],
    )
    # clusters are dealt to blocks by a hash; their number is counted where they are
    n = values.count()
    blocks = max(1, -(-n // CLUSTER_BLOCK))
    own = own.withColumn("_block", F.pmod(F.xxhash64("_c"), F.lit(blocks)).cast("int"))

    def partial(rows: pa.Table) -> pa.Table:
        at = rows.column("_range")[0].as_py()
        first = at * FLIP_RANGE
        n = -(-min(FLIP_RANGE, flips - first) // BITS) * BITS
        names = rows.column("_c").to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)  # sums do not depend on the order of arrival
        v = np.stack([rows.column(f"_v{i}").to_numpy() for i in range(len(columns))])[:, order]
        s = sign_bits(seed, [names[i] for i in order], first, n)[:, : min(FLIP_RANGE, flips - first)]
        sums = np.concatenate([v @ s[:, i : i + 1024].astype(np.float64) for i in range(0, s.shape[1], 1024)], axis=1)
        return pa.table(
            {"_range": pa.array([at], pa.int32()), "_block": rows.column("_block")[:1], "sums": pa.array([np.ascontiguousarray(sums).tobytes()], pa.binary())}
        )

    def added(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_block")
        total = sum(np.frombuffer(x, np.float64) for x in rows.column("sums").to_pylist())
        at = rows.column("_range")[0].as_py()
        n = len(total) // len(columns)
        return pa.table({"first": pa.array([at * FLIP_RANGE], pa.int64()), "n": pa.array([n], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = own.groupBy("_range", "_block").applyInArrow(partial, "_range int, _block int, sums binary")
    return parts.groupBy("_range").applyInArrow(added, "first long, n int, sums binary")


def count_extreme(sums: DataFrame, totals: DataFrame, effects: Callable[[np.ndarray, dict], list[tuple[np.ndarray, float]]], n_effects: int, tolerance: float) -> DataFrame:
    """``effect`` (number), ``observed``, ``n_extreme``: flips whose effect is at least as large as the observed one.

    ``totals`` has one row; ``effects(sums, totals)`` gives each effect's values and its observed value.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["sums"], np.float64).reshape(-1, row["n"])
                found = effects(own, row)
                hits = [int((np.abs(v) + tolerance >= abs(o)).sum()) if o is not None else 0 for v, o in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n_effects), pa.int32()), pa.array([o for _, o in found], pa.float64()), pa.array(hits, pa.int64())],
                    ["effect", "observed", "n_extreme"],
                )

    rows = sums.join(F.broadcast(totals), F.lit(True)).mapInArrow(run, "effect int, observed double, n_extreme long")  # one-row side
    return rows.groupBy("effect").agg(F.max("observed").alias("observed"), F.sum("n_extreme").alias("n_extreme"))
