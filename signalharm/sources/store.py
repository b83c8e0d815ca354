"""Signal store: axes once, signals with a reference, results, views, validation."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.quantiles import exact_quantiles


def axis_key(axis):
    """Content id of an axis."""
    return F.sha2(
        F.concat_ws("#", F.size(axis), F.array_join(F.transform(axis, lambda v: v.cast("string")), ",")), 256
    )


def write(signals: DataFrame, path: str) -> None:
    """Two tables: distinct axes, and signals by dataset with an axis id."""
    keyed = signals.withColumn("axis_id", axis_key("axis"))
    keyed.select("axis_id", "axis").dropDuplicates(["axis_id"]).write.mode("overwrite").parquet(f"{path}/axes")
    keyed.drop("axis").write.mode("overwrite").partitionBy("dataset_id").parquet(f"{path}/signals")


def read(spark: SparkSession, path: str, dataset_id=None, signal_ids=None) -> DataFrame:
    """Signals with their axis; dataset prunes partitions, ids reach the scan."""
    s = spark.read.parquet(f"{path}/signals")
    if dataset_id is not None:
        s = s.filter(F.col("dataset_id") == dataset_id)
    if signal_ids is not None:
        s = s.filter(F.col("signal_id").isin(list(signal_ids)))
    return s.join(spark.read.parquet(f"{path}/axes"), "axis_id").drop("axis_id")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    s = spark.read.parquet(f"{path}/signals").agg(
        F.count(F.lit(1)).alias("n_signals"), F.count_distinct("dataset_id").alias("n_partitions")
    )
    a = spark.read.parquet(f"{path}/axes").agg(F.count(F.lit(1)).alias("n_axes"))
    return s.join(F.broadcast(a), F.lit(True))  # one-row side


def write_perturbed(perturbed: DataFrame, path: str, perturbations, n_strengths: int) -> None:
    """Records per strength, and a status per (source, perturbation)."""
    out = perturbed.drop("ref_axis", "ref_y", "regions")
    out.filter(F.col("y").isNotNull()).write.mode("overwrite").partitionBy("perturbation_id").parquet(f"{path}/records")
    records = out.sparkSession.read.parquet(f"{path}/records")
    done = records.groupBy("signal_id", "perturbation_id").agg(F.count_distinct("alpha").alias("n"))
    sources = out.select("signal_id").distinct()
    planned = sources.select(
        "signal_id", F.explode(F.array(*[F.lit(p) for p in perturbations])).alias("perturbation_id")
    )
    cells = planned.join(done, ["signal_id", "perturbation_id"], "left").select(
        "signal_id",
        "perturbation_id",
        F.when(F.col("n") == n_strengths, "complete").otherwise("failed").alias("status"),
    )
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    sources.write.mode("overwrite").parquet(f"{path}/sources")


def read_perturbed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records")


def write_results(df: DataFrame, path: str, columns) -> None:
    """CSV (empty text for null) and JSON lines, columns as named and rows in their order."""
    out = df.select(*columns).orderBy(*columns)
    out.write.mode("overwrite").csv(f"{path}/csv", header=True, nullValue="", emptyValue="")
    out.write.mode("overwrite").json(f"{path}/json")


def pending(planned: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Work units without a finished result."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def violations(signals: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per (signal, violated rule)."""
    x, y = F.col("axis"), F.col("y")
    finite = lambda a: ~F.exists(a, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    monotone = A.let(
        A.differences(x),
        lambda d: F.forall(d, lambda v: v > 0) | F.forall(d, lambda v: v < 0),
    )
    codes = F.array_compact(
        F.array(
            F.when(~(finite(x) & finite(y)), F.lit("not_finite")),
            F.when(F.size(x) != F.size(y), F.lit("length_mismatch")),
            F.when(~monotone, F.lit("axis_not_monotone")),
        )
    )
    rows = signals.select("signal_id", F.explode(codes).alias("code"))
    unknown = signals.join(classes, "class_id", "left_anti").select("signal_id", F.lit("unknown_class").alias("code"))
    repeated = (
        signals.groupBy("signal_id").count().filter("count > 1").select("signal_id", F.lit("duplicate_id").alias("code"))
    )
    return rows.unionByName(unknown).distinct().unionByName(repeated)


def named_views(records: DataFrame) -> DataFrame:
    """``condition-role`` views with their algebra checked against the parent sets.

    ``records``: record_id, condition, role.  A record belongs to one condition
    and one role, so views partition the records and each equals the
    intersection of its condition set and its role set.
    """
    per = records.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("condition").alias("condition"),
        F.min("role").alias("role"),
        (F.min("condition") != F.max("condition")).alias("c_many"),
        (F.min("role") != F.max("role")).alias("r_many"),
    )
    v = per.groupBy(F.concat_ws("-", "condition", "role").alias("view_id")).agg(
        F.sum("n").alias("n"),
        (~F.max(F.col("c_many") | F.col("r_many"))).alias("is_intersection"),
    )
    whole = per.agg(
        (F.count_if(F.col("c_many") | F.col("r_many")) == 0).alias("disjoint"),
        (F.count_if(F.col("condition").isNull() | F.col("role").isNull()) == 0).alias("exhaustive"),
    )
    return v.join(F.broadcast(whole), F.lit(True))  # one-row side


def endmembers(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Exact pointwise median signal per key, re-collected in node order."""
    nodes = signals.select(*keys, F.posexplode("y").alias("i", "v"))
    med = exact_quantiles(nodes, [*keys, "i"], "v", {"m": 0.5})
    g = med.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))  # one per node
    return g.select(*keys, F.transform("p", lambda e: e["m"]).alias("y"))
