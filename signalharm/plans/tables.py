"""Bindings of the driver tables to the signal model."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a file has fewer splits than the cluster has cores.

    Per-signal work is compute-bound, so a one-split file would run on one
    core.  Large inputs already have more splits and pass through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as signals on the axis 1..n; groups are blocks of ids in a class."""
    return spread(table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("signal_id"),
        F.col("label").cast("long").alias("class_id"),
        F.concat(
            F.lit("c"), F.col("label"), F.lit("-g"), F.floor(F.col("vec_id") / 50).cast("long")
        ).alias("group_id"),
        F.transform(
            F.sequence(F.lit(1), F.size("embedding")), lambda i: i.cast("double")
        ).alias("axis"),
        F.col("embedding").cast("array<double>").alias("y"),
    )


# The same binding in long form for DuckDB; ends inside a WITH list.
SQL_SIGNALS = """
sig AS MATERIALIZED (
  SELECT vec_id AS signal_id, label::BIGINT AS class_id,
         'c' || label || '-g' || (vec_id // 50) AS group_id,
         i::BIGINT AS i, i::DOUBLE AS x, embedding[i]::DOUBLE AS y, len(embedding)::BIGINT AS n
  FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)
)"""

# Hash draws, as text functions for building SQL.
def sql_uniform(key: str, start: int = 1) -> str:
    return f"(('0x' || substr(md5({key}), {start}, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def sql_normal(key: str) -> str:
    return (
        f"(sqrt(-2.0 * ln({sql_uniform(key, 1)} + 0.5 / 4503599627370496.0::DOUBLE))"
        f" * cos(2.0 * pi() * {sql_uniform(key, 14)}))"
    )
