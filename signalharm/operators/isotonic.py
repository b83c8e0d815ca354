"""Weighted isotonic regression per key, exact, for many small or a few huge keys.

Rows collapse to one point per (key, x) with a partial aggregate.  Keys whose
points fit one task are fitted by a grouped map.  Only the keys above ``limit``
are cut into x-ranges that are pooled independently; pools are themselves
points, so neighbouring ranges whose facing pools are not in increasing order are
united and pooled again.  When none are left the fit is increasing, and as
pooling adjacent violators in any order gives the same fit, it is exact.
"""

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import ensure_checkpoint_dir

LIMIT = 1_000_000
BUCKET_ROWS = 100_000


def points(df: DataFrame, keys: list[str], x: str, y: str, w: str | None = None) -> DataFrame:
    """One row per (key, x): weight and the sums needed for a squared error."""
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    return df.groupBy(*keys, F.col(x).alias("x_lo")).agg(
        F.sum(weight).alias("sw"),
        F.sum(weight * F.col(y)).alias("swy"),
        F.sum(weight * F.col(y) * F.col(y)).alias("swyy"),
    ).filter(F.col("sw") > 0).withColumn("x_hi", F.col("x_lo"))


def pool_adjacent(sw: np.ndarray, swy: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Pool number of each point; points are ordered by (key, x), ``first`` marks a new key."""
    starts = []
    weight, total, start = [], [], []
    for k, (a, b, fresh) in enumerate(zip(sw.tolist(), swy.tolist(), first.tolist())):
        if fresh:
            starts += start
            weight, total, start = [], [], []
        s = k
        while weight and total[-1] * a >= b * weight[-1]:
            a, b, s = a + weight.pop(), b + total.pop(), start.pop()
        weight.append(a)
        total.append(b)
        start.append(s)
    marks = np.zeros(len(sw), dtype=np.int64)
    marks[starts + start] = 1
    return np.cumsum(marks) - 1


def _ordered(pdf: pd.DataFrame, keys: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values([*keys, "x_lo"], kind="stable")
    first = np.zeros(len(pdf), dtype=bool)
    first[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        first[1:] |= v[1:] != v[:-1]
    return pdf, pool_adjacent(pdf["sw"].to_numpy(), pdf["swy"].to_numpy(), first)


def _merge(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pool = _ordered(pdf, keys)
        starts = np.flatnonzero(np.diff(pool, prepend=-1))
        ends = np.append(starts[1:], len(pdf)) - 1
        out = pdf.iloc[starts].copy()
        out["x_hi"] = pdf["x_hi"].to_numpy()[ends]
        for c in ("sw", "swy", "swyy"):
            out[c] = np.add.reduceat(pdf[c].to_numpy(), starts)
        return out

    return run


def _fit_points(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pool = _ordered(pdf, keys)
        sw = np.bincount(pool, weights=pdf["sw"])
        swy = np.bincount(pool, weights=pdf["swy"])
        return pdf.assign(fit=(swy / sw)[pool])

    return run


def _schema(df: DataFrame, *extra: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + list(extra))


def _sizes(df: DataFrame, keys) -> tuple[int, int]:
    """Largest key and total number of points."""
    top, total = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return top or 0, total or 0


def _split(pts: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Points of the keys within the limit, and those of the larger keys (at most total / limit keys)."""
    large = pts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).count().filter(F.col("count") > limit).drop("count")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return pts.join(large, same, "left_anti"), pts.join(large, same, "left_semi")


def _by_bucket(df: DataFrame, keys: list[str], run, schema: str, total: int) -> DataFrame:
    """Fit many whole keys per task: small keys share a hash bucket, which saves
    the per-group overhead of a grouped map."""
    buckets = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))

    def drop_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.drop(columns="_bucket"))

    return df.groupBy("_bucket").applyInPandas(drop_bucket, schema)


def _joined(df: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join on equal or both null columns that keeps one copy of them."""
    own = other.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return df.join(own, same, how).drop(*(f"_on_{c}" for c in on))


def _with_chunk(df: DataFrame, keys, parts: int, column: str = "x_lo") -> DataFrame:
    """Number the x-range of each row; the small table of cuts is checkpointed so
    that a recomputed task sees the same cuts."""
    probs = [k / parts for k in range(1, parts)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(column, probs, 10_000).alias("_cuts")).checkpoint()
    joined = _joined(df, cuts, keys, "inner")
    return joined.withColumn("_chunk", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")


def _to_merge(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _chunk, _next: the range that a range joins, where facing pools are not in increasing order.

    One row per range is compared.  In a row of such ranges every second joins
    the one before it, so what one task holds at most doubles.
    """
    level = F.col("swy") / F.col("sw")
    ends = chunked.groupBy(*keys, "_chunk").agg(F.min_by(level, "x_lo").alias("_head"), F.max_by(level, "x_lo").alias("_tail"))
    order = Window.partitionBy(*keys).orderBy("_chunk")
    facing = ends.withColumn("_bad", F.coalesce(F.lag("_tail").over(order) >= F.col("_head"), F.lit(False)))
    facing = facing.withColumn("_before", F.lag("_chunk").over(order))
    facing = facing.withColumn("_run", F.sum((~F.col("_bad")).cast("int")).over(order))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy("_chunk"))
    return facing.filter("_bad").withColumn("_place", place).filter("_place % 2 = 1").select(*keys, "_chunk", F.col("_before").alias("_next"))


def _pool_large(pts: DataFrame, keys: list[str], limit: int, top: int) -> DataFrame:
    chunked = _with_chunk(pts, keys, -(-2 * top // limit) + 1)
    while True:
        chunked = chunked.groupBy(*keys, "_chunk").applyInPandas(_merge([*keys, "_chunk"]), _schema(chunked)).checkpoint()
        joins = _to_merge(chunked, keys).checkpoint()
        if not joins.count():
            return chunked.drop("_chunk")
        chunk = F.coalesce("_next", "_chunk")
        chunked = _joined(chunked, joins, [*keys, "_chunk"], "left").withColumn("_chunk", chunk).drop("_next")


def pools(pts: DataFrame, keys: list[str], limit: int = LIMIT, sizes=None) -> DataFrame:
    """Maximal blocks of equal fit: keys, x_lo, x_hi, sw, swy, swyy.

    ``sizes`` = (largest key, total points), where the caller can bound them
    without running the plan.
    """
    top, total = sizes or _sizes(pts, keys)
    if top <= limit:
        return _by_bucket(pts, keys, _merge(keys), _schema(pts), total)
    ensure_checkpoint_dir(pts.sparkSession)
    pts = pts.checkpoint()
    small, large = _split(pts, keys, limit)
    return _by_bucket(small, keys, _merge(keys), _schema(pts), total).unionByName(_pool_large(large, keys, limit, top))


def fit_points(pts: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """Every point with its fitted value ``fit``."""
    top, total = _sizes(pts, keys)
    if top <= limit:
        return _by_bucket(pts, keys, _fit_points(keys), _schema(pts, "fit double"), total)
    ensure_checkpoint_dir(pts.sparkSession)
    pts = pts.checkpoint()
    small, pts = _split(pts, keys, limit)
    fitted_small = _by_bucket(small, keys, _fit_points(keys), _schema(pts, "fit double"), total)
    blocks = _pool_large(pts, keys, limit, top).select(*keys, "x_lo", (F.col("swy") / F.col("sw")).alias("fit"))
    parts = -(-2 * top // limit) + 1
    tagged = pts.select("*", F.lit(None).cast("double").alias("fit"))
    markers = blocks.select(
        *keys,
        "x_lo",
        *[F.lit(None).cast("double").alias(c) for c in ("sw", "swy", "swyy", "x_hi")],
        "fit",
    )
    # the block of a point is the last block that starts at or before it: carry
    # the marker forward inside each x-range, then across ranges
    both = _with_chunk(tagged.unionByName(markers), keys, parts).checkpoint()

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_p=pdf["sw"].notna()).sort_values(["x_lo", "_p"], kind="stable")
        return pdf.assign(fit=pdf["fit"].ffill()).drop(columns="_p")

    filled = both.groupBy(*keys, "_chunk").applyInPandas(carry, _schema(both))
    last = both.filter(F.col("fit").isNotNull()).groupBy(*keys, "_chunk").agg(
        F.max_by("fit", "x_lo").alias("_last")
    )
    heads = last.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_chunk", "_last"))).alias("_heads")
    )  # one entry per x-range
    before = F.element_at(
        F.filter("_heads", lambda h: h["_chunk"] < F.col("_chunk")), -1
    )["_last"]
    large = (
        filled.filter(F.col("sw").isNotNull())
        .transform(lambda df: _joined(df, heads, keys, "inner"))
        .withColumn("fit", F.coalesce("fit", F.when(F.size(F.filter("_heads", lambda h: h["_chunk"] < F.col("_chunk"))) > 0, before)))
        .drop("_chunk", "_heads")
    )
    return fitted_small.unionByName(large)


def isotonic_fit(
    df: DataFrame, keys: list[str], x: str, y: str, w: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """Rows with ``fit``, the increasing weighted least-squares value at their x."""
    fitted = fit_points(points(df, keys, x, y, w), keys, limit)
    return df.join(fitted.select(*keys, F.col("x_lo").alias(x), "fit"), [*keys, x])
