"""Mixing sources to target weights as a Pfair schedule, with DataFrame functions alone.

A source with weight w owns block k (from 0) from its release floor(k / w) to its
deadline ceil((k + 1) / w); each slot goes to the released block with the
earliest deadline.  As the weights add up to 1, every block keeps its window and
no source is ever one block or more away from its weight.  Weights are multiples
of 1 / ``slots``, so the schedule repeats: one period is computed, from the
weights alone, and every block finds its slot by arithmetic.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalharm.llm.common import small, stored

SLOTS = 1000
BLOCK_ROWS = 16
#: Weights grow as this power of a source's rows: large sources are held back a little.
POWER = 0.9
#: Rows that one cell of the distributed ranking holds, about.
CELL_ROWS = 1000
#: Rows of the plan of sources and of one period that are broadcast at most.
BROADCAST_ROWS = 200_000


def tempered_weights(counts: DataFrame, power: float = POWER) -> DataFrame:
    """source, weight: rows ** power.  ``counts``: source, n."""
    return counts.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def shares(weights: DataFrame, slots: int = SLOTS) -> DataFrame:
    """source, share: whole slots of a period, at least 1 each, by largest remainders.

    One row per source goes through one window: the list of sources is a setting
    of the mixture, not data that grows with the rows.  With more than
    ``slots / 2`` sources the period becomes twice their number.
    """
    every = Window.partitionBy()
    quota = (F.col("slots") - F.count("*").over(every)) * F.col("weight") / F.sum("weight").over(every)
    out = weights.withColumn("slots", F.greatest(F.lit(slots).cast("long"), 2 * F.count("*").over(every)))
    out = out.withColumn("quota", quota).withColumn("whole", F.floor("quota"))
    left = F.col("slots") - F.count("*").over(every) - F.sum("whole").over(every)
    place = F.row_number().over(Window.orderBy((F.col("whole") - F.col("quota")), "source"))
    out = out.withColumn("left", left).withColumn("place", place)
    return out.select("source", (F.col("whole") + 1 + (F.col("place") <= F.col("left")).cast("long")).alias("share"), "slots")


def period(plan: DataFrame) -> DataFrame:
    """source, turn, slot_in_period: earliest deadline first over one period of ``plan`` (source, share, slots)."""
    one = plan.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "share"))).alias("s"), F.max("slots").alias("slots"))
    state = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picks"))

    def pick(a: Column, t: Column) -> Column:
        waiting = F.transform(
            F.arrays_zip(F.col("s.share").alias("share"), a["done"].alias("done")),
            lambda x, i: F.struct(
                # blocks that are not released yet come last
                F.when(F.floor(x["done"] * F.col("slots") / x["share"]) <= t, F.lit(0)).otherwise(F.lit(1)).alias("late"),
                F.ceil((x["done"] + 1) * F.col("slots") / x["share"]).alias("deadline"),
                i.alias("i"),
            ),
        )
        return F.array_min(waiting)["i"]

    def step(a: Column, t: Column) -> Column:
        return F.element_at(
            F.transform(
                F.array(pick(a, t)),
                lambda p: F.struct(
                    F.transform(a["done"], lambda d, i: d + (i == p).cast("long")).alias("done"),
                    F.concat(a["picks"], F.array(p)).alias("picks"),
                ),
            ),
            1,
        )

    picked = one.where(F.size("s") > 0).select(
        "s", F.posexplode(F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), state, step)["picks"])
    )
    turn = F.row_number().over(Window.partitionBy("source").orderBy("slot_in_period")) - 1
    return picked.select(F.element_at("s", F.col("col") + 1)["source"].alias("source"), F.col("pos").cast("long").alias("slot_in_period")).withColumn("turn", turn.cast("long"))


def mixture(
    docs: DataFrame,
    weights: DataFrame | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    slots: int = SLOTS,
    block_rows: int = BLOCK_ROWS,
    power: float = POWER,
    key_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, block, place (in the block), slot, release, deadline, in_mix.

    Sorted by slot and place, the rows are the mixture.  A source's rows are
    dealt to its blocks by the MD5 of their ids.  ``weights`` (source, weight)
    must name every source; by default they are ``tempered_weights``.  A source
    that has run out leaves its slots empty.  ``in_mix`` ends where the last
    source with no more rows than its weight asks for has run out: what is left
    then are only rows of over-supplied sources.  A null source counts as "",
    null ids as "", and an empty table gives no rows.  ``key_col`` is carried along.
    """
    key = [key_col] if key_col else []
    rows = docs.select(
        *key,
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("deal"),
    )
    counts = stored(rows.groupBy("source").agg(F.count("*").alias("n")), "source-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    digits = 1
    while total > CELL_ROWS * 16**digits:
        digits += 1
    if weights is not None and counts.join(weights, "source", "left_anti").limit(1).count():
        raise ValueError("a source has no weight")
    plan = shares(weights or tempered_weights(counts, power), slots).join(counts, "source")
    plan = stored(plan, "source-plan")
    turns = stored(period(plan), "period")

    rows = rows.withColumn("cell", F.substring("deal", 1, digits))
    cells = rows.groupBy("source", "cell").agg(F.count("*").alias("in_cell"))
    below = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.select("source", "cell", F.coalesce(F.sum("in_cell").over(below), F.lit(0)).alias("below")), "cells")
    in_cell = F.row_number().over(Window.partitionBy("source", "cell").orderBy("deal", "doc_id"))
    ranked = rows.withColumn("in_cell", in_cell).join(small(cells, BROADCAST_ROWS), ["source", "cell"])
    rank = F.col("below") + F.col("in_cell") - 1

    def slot_of(block: Column) -> Column:
        return (block / F.col("share")).cast("long") * F.col("slots") + F.col("slot_in_period")

    ends = plan.withColumn("last", F.floor((F.col("n") - 1) / block_rows))
    ends = ends.withColumn("turn", F.col("last") % F.col("share")).join(turns, ["source", "turn"])
    ends = ends.where(F.col("share") * total >= F.col("n") * F.col("slots"))
    horizon = ends.agg(F.max(slot_of(F.col("last")))).first()[0] or 0

    out = ranked.select(*key, "doc_id", "source", F.floor(rank / block_rows).alias("block"), (rank % block_rows).alias("place"))
    out = out.join(small(plan.select("source", "share", "slots"), BROADCAST_ROWS), "source")
    out = out.withColumn("turn", F.col("block") % F.col("share")).join(small(turns, BROADCAST_ROWS), ["source", "turn"])
    slot = slot_of(F.col("block"))
    return out.select(
        *key,
        "doc_id",
        "source",
        "block",
        "place",
        slot.alias("slot"),
        F.floor(F.col("block") * F.col("slots") / F.col("share")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("slots") / F.col("share")).alias("deadline"),
        (slot <= horizon).alias("in_mix"),
    )
