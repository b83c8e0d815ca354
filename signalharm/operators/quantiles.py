"""Exact grouped quantiles that never gather a group in one task."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import ensure_checkpoint_dir


def with_cells(df: DataFrame, keys: list[str], value: str, cells: int) -> DataFrame:
    """Add ``_cell``: cells of about equally many rows of each key, in order of ``value``.

    Cuts lie at approximate percentiles, so skewed values spread as well as even
    ones.  They are checkpointed: every use of the cells sees the same cuts.
    Keys that are null stay.
    """
    ensure_checkpoint_dir(df.sparkSession)
    probs = [k / cells for k in range(1, cells)]
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, probs, 10_000)).alias("_cuts")).checkpoint()
    cuts = cuts.withColumnsRenamed({k: f"_cut_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_cut_{k}")) for k in keys), F.lit(True))
    cell = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    return df.join(cuts, same).withColumn("_cell", cell).drop("_cuts", *(f"_cut_{k}" for k in keys))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bins: int = 128
) -> DataFrame:
    """Linear-interpolation quantiles of ``value`` per key.

    Equal values collapse first (map-side), distinct values fall into ``bins``
    cells of about equal size, and ranks come from a prefix sum over cells plus
    a prefix sum inside each cell.  A hot key is therefore spread over its
    cells; no task holds the whole group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    totals = df.groupBy(*keys).agg(F.count(value).alias("_total"))
    counted = with_cells(counted, keys, value, bins).join(totals, keys)
    cells = counted.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_m"))
    before = F.sum("_m").over(
        Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = cells.select(*keys, "_cell", F.coalesce(before, F.lit(0)).alias("_off"))
    inside = F.sum("_n").over(
        Window.partitionBy(*keys, "_cell")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.join(offsets, [*keys, "_cell"]).withColumn("_upto", F.col("_off") + inside)

    def at(rank):
        hit = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
        return F.max(F.when(hit, F.col(value)))

    aggregates = []
    for name, q in probs.items():
        h = (F.col("_total") - 1) * F.lit(float(q))
        aggregates += [
            at(F.floor(h)).alias(f"_l_{name}"),
            at(F.ceil(h)).alias(f"_u_{name}"),
            F.max(h - F.floor(h)).alias(f"_f_{name}"),
        ]
    out = ranked.groupBy(*keys).agg(*aggregates)
    return out.select(
        *keys,
        *[
            (
                F.col(f"_l_{n}") + F.col(f"_f_{n}") * (F.col(f"_u_{n}") - F.col(f"_l_{n}"))
            ).alias(n)
            for n in probs
        ],
    )
