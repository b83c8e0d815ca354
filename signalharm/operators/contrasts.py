"""Contrasts between panels, formed inside every draw before its percentile.

Statistics of several panels stand side by side in one row per draw, because all
panels of an endpoint share its draw table; differences, interactions and shares
are expressions over that row.  The point estimate is the same expression over
the full-sample statistics.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .infer import bootstrap_sums


def endpoint_vector(stats: DataFrame, by: list[str], endpoints: dict[str, tuple[dict[str, str], str]]) -> DataFrame:
    """One row per ``by`` with named statistics: ``endpoints`` maps a name to (cell, column) of ``stats``."""

    def at(cell, column):
        return F.max(F.when(reduce(and_, (F.col(k) == v for k, v in cell.items())), F.col(column)))

    return stats.groupBy(*by).agg(*[at(cell, column).alias(name) for name, (cell, column) in endpoints.items()])


def contrast_intervals(
    point: DataFrame, drawn: DataFrame, by: list[str], endpoints: dict, contrasts: dict[str, Column], confidence: float = 0.95
) -> DataFrame:
    """``by`` and each contrast with ``_lower`` and ``_upper``.

    ``point`` and ``drawn`` (with ``resample``) hold the same statistics.  An
    interval is null if a draw lacks the contrast.
    """
    formed = [c.alias(name) for name, c in contrasts.items()]
    own = endpoint_vector(point, by, endpoints).select(*by, *formed)
    each = endpoint_vector(drawn, [*by, "resample"], endpoints).select(*by, "resample", *formed)
    bounds = percentile_bounds(each, by, list(contrasts), confidence)
    return own.join(bounds, by) if by else own.join(F.broadcast(bounds), F.lit(True))  # one row


def percentile_bounds(each: DataFrame, by: list[str], columns: list[str], confidence: float = 0.95) -> DataFrame:
    """``_lower`` and ``_upper`` of each column over the draws; null where a draw has none."""
    a = (1 - confidence) / 2
    out = []
    for c in columns:
        p = F.percentile(c, F.array(F.lit(a), F.lit(1 - a)))
        whole = F.count(c) == F.count(F.lit(1))
        out += [F.when(whole, p[0]).alias(f"{c}_lower"), F.when(whole, p[1]).alias(f"{c}_upper")]
    return each.groupBy(*by).agg(*out) if by else each.agg(*out)


def shares(
    values: DataFrame, cluster: str, by: list[str], family: str, groups: dict[str, tuple[str, ...]], draws: DataFrame, confidence: float = 0.95
) -> DataFrame:
    """Shares of families, and of named groups of them, in the sums of positive and absolute harm.

    ``values``: by, cluster, family, y.  Parts are taken before averaging, and
    the ratio is formed inside each draw.  A total of zero leaves a share
    undefined; an interval needs all draws.
    """
    y = F.col("y")
    parts = values.groupBy(*by, cluster, family).agg(
        F.sum(F.greatest(y, F.lit(0.0))).alias("positive"), F.sum(F.abs(y)).alias("absolute"), F.count("y").alias("n")
    )
    columns = ["positive", "absolute", "n"]
    whole = parts.groupBy(*by, family).agg(*[F.sum(c).alias(c) for c in columns]).withColumn("resample", F.lit(-1))
    drawn = bootstrap_sums(parts, cluster, [*by, family], columns, draws).drop("_w")
    each = whole.unionByName(drawn.withColumn("resample", F.col("resample").cast("int")))
    total = Window.partitionBy(*by, "resample")  # the families of one draw
    kinds = ("positive", "absolute")
    each = each.withColumns({c: F.col(c) / F.col("n") for c in kinds})
    each = each.withColumns({f"_{c}": F.sum(c).over(total) for c in kinds})
    each = each.withColumns({f"{c}_share": F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")) for c in kinds})
    names = F.array_compact(
        F.array(F.col(family), *[F.when(F.col(family).isin(*members), F.lit(name)) for name, members in groups.items()])
    )
    each = each.withColumn("component", F.explode(names)).groupBy(*by, "component", "resample").agg(
        *[F.sum(f"{c}_share").alias(f"{c}_share") for c in kinds]
    )
    columns = [f"{c}_share" for c in kinds]
    point = each.filter("resample = -1").drop("resample")
    bounds = percentile_bounds(each.filter("resample >= 0"), [*by, "component"], columns, confidence)
    out = point.join(bounds, [*by, "component"])
    return out.withColumns(
        {
            f"{c}_state": F.when(F.col(f"{c}_share").isNull(), "undefined")
            .when(F.col(f"{c}_share_lower").isNull(), "bootstrap_undefined")
            .otherwise("complete")
            for c in kinds
        }
    )
