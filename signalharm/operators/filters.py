"""Predicates and id-set algebra."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stratum(value: Column, bounds) -> Column:
    """Named half-open intervals; the last one includes its upper bound; else null."""
    out = F.lit(None).cast("string")
    for k, (name, lo, hi) in reversed(list(enumerate(bounds))):
        upper = value <= hi if k == len(bounds) - 1 else value < hi
        out = F.when((value >= lo) & upper, name).otherwise(out)
    return out


def allowed(df: DataFrame, status: str, alphas) -> DataFrame:
    """Rows of one known status on the strength grid; both predicates reach the scan."""
    return df.filter((F.col("status") == status) & F.col("alpha").isin(*alphas))


def set_sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union, intersection and differences of two id sets from one aggregate."""
    sides = (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .groupBy(key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return sides.agg(
        F.count(F.lit(1)).alias("n_union"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("n_right_only"),
    )
