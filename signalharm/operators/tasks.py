"""Downstream tasks: library identification, reports, harms."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 12  # makes equal cosines equal whatever the summation order
TILE_ROWS = 4096


def _schema(df: DataFrame, names) -> str:
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{n}` {fields[n]}" for n in names)


def class_scores(
    queries: DataFrame,
    library: DataFrame,
    keys: list[str],
    query_id: list[str],
    tile_rows: int = TILE_ROWS,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Best cosine per (query, class) and the library member that attains it.

    ``queries``: keys, query_id.., v; ``library``: keys, lib_id, class_id, v;
    both sides unit length.  Blocked matrix products: both sides are hashed
    into tiles of about ``tile_rows`` rows, each pair of tiles meets in one
    grouped task and leaves one row per (query, class); no pair is emitted
    and nothing is broadcast.  ``sizes`` gives the largest number of library
    and query rows per key where the caller knows it from a cheaper table.
    """

    def rows(df):
        return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1

    n_lib, n_query = sizes or (rows(library), rows(queries))
    nl, nq = (max(1, -(-n // tile_rows)) for n in (n_lib, n_query))
    lib = library.select(*keys, "lib_id", "class_id", "v").withColumns(
        {
            "_l": F.pmod(F.xxhash64("lib_id"), F.lit(nl)).cast("int"),
            "_q": F.explode(F.sequence(F.lit(0), F.lit(nq - 1))),
        }
    )
    q = queries.select(*keys, *query_id, "v").withColumns(
        {
            "_q": F.pmod(F.xxhash64(*query_id), F.lit(nq)).cast("int"),
            "_l": F.explode(F.sequence(F.lit(0), F.lit(nl - 1))),
        }
    )

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*keys, *query_id, "class_id", "score", "lib_id"])
        b = b.sort_values("lib_id", kind="stable")
        s = np.clip(np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T, -1.0, 1.0)
        s = np.round(s, SCORE_DIGITS)
        classes = b["class_id"].to_numpy()
        ids = b["lib_id"].to_numpy()
        parts = []
        for c in np.unique(classes):
            cols = np.flatnonzero(classes == c)
            k = s[:, cols].argmax(axis=1)
            part = a[[*keys, *query_id]].copy()
            part["class_id"] = c
            part["score"] = s[np.arange(len(a)), cols[k]]
            part["lib_id"] = ids[cols[k]]
            parts.append(part)
        return pd.concat(parts)

    # the library side gets names of its own: both sides may stem from one table
    group = [*keys, "_l", "_q"]
    lib = lib.select(*[F.col(c).alias(f"r_{c}" if c in group else c) for c in lib.columns])
    out = (
        q.groupBy(*group)
        .cogroup(lib.groupBy(*[f"r_{c}" for c in group]))
        .applyInPandas(
            product,
            _schema(queries, [*keys, *query_id])
            + ", "
            + _schema(library, ["class_id"])
            + ", score double, "
            + _schema(library, ["lib_id"]),
        )
    )
    if nl == 1:
        return out
    best = F.max(F.struct("score", (-F.col("lib_id")).alias("m")))
    return (
        out.groupBy(*keys, *query_id, "class_id")
        .agg(best.alias("b"))
        .select(*keys, *query_id, "class_id", "b.score", (-F.col("b.m")).alias("lib_id"))
    )


def rank_classes(scores: DataFrame, query: list[str]) -> DataFrame:
    """Rank by score, then class id; a query has at most one row per class."""
    w = Window.partitionBy(*query).orderBy(F.desc("score"), "class_id")
    return scores.withColumn("rank", F.row_number().over(w))


def topk(ranked: DataFrame, query: list[str], truth: str = "true_class", k: int = 5) -> DataFrame:
    """Top-1 and top-k hits; null when the true class is not in the library."""
    hit = F.col("class_id") == F.col(truth)
    return ranked.groupBy(*query, truth).agg(
        F.max(F.when(F.col("rank") == 1, F.col("class_id"))).alias("predicted_class"),
        F.max(F.when(hit, F.col("rank"))).alias("true_rank"),
    ).withColumns(
        {
            "top1": (F.col("true_rank") == 1),
            "topk": (F.col("true_rank") <= k),
        }
    )


def confusion(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_metrics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per class recall, precision, F1 from a confusion table; zero division is 0."""
    sides = cells.select(*keys, F.col("t").alias("class_id"), "n", F.lit("t").alias("s"), (F.col("t") == F.col("p")).alias("hit")).unionByName(
        cells.select(*keys, F.col("p").alias("class_id"), "n", F.lit("p").alias("s"), F.lit(False).alias("hit"))
    )
    g = sides.groupBy(*keys, "class_id").agg(
        F.sum(F.when(F.col("s") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s") == "p", F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    return g.withColumns(
        {
            "recall": ratio(F.col("tp"), F.col("support")),
            "precision": ratio(F.col("tp"), F.col("predicted")),
            "f1": ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")),
        }
    )


def classification_report(per_class: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy over true classes, macro F1 over seen classes."""
    return per_class.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def regression_report(df: DataFrame, keys: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """RMSE, MAE, R2 and range-normalised RMSE per target."""
    e = F.col(pred) - F.col(truth)
    g = df.groupBy(*keys).agg(
        F.count(e).alias("n"),
        F.sum(e * e).alias("sse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.var_pop(truth) * F.count(truth)).alias("sst"),
        (F.max(truth) - F.min(truth)).alias("range"),
    )
    rmse = F.sqrt(F.col("sse") / F.col("n"))
    return g.select(
        *keys,
        "n",
        rmse.alias("rmse"),
        "mae",
        F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"),
        F.when(F.col("range") > 0, rmse / F.col("range")).alias("normalized_rmse"),
    )


def against_baseline(df: DataFrame, keys: list[str], value: str, higher_is_better: bool) -> DataFrame:
    """Harm of every condition against its own alpha-0 row."""
    base = df.filter(F.col("alpha") == 0).select(*keys, F.col(value).alias("_base"))
    harm = F.col("_base") - F.col(value) if higher_is_better else F.col(value) - F.col("_base")
    return df.filter(F.col("alpha") > 0).join(base, keys).withColumn("harm", harm).drop("_base")


def harm_parts(df: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """Signed, positive, negative and absolute means; parts are taken before averaging."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(
        F.avg(v).alias("signed_mean"),
        F.avg(F.greatest(v, F.lit(0.0))).alias("positive_mean"),
        F.avg(F.greatest(-v, F.lit(0.0))).alias("negative_mean"),
        F.avg(F.abs(v)).alias("absolute_mean"),
    )
    a = F.col("absolute_mean")
    return g.withColumns(
        {
            "positive_share": F.when(a > 0, F.col("positive_mean") / a),
            "negative_share": F.when(a > 0, F.col("negative_mean") / a),
            "denominator_state": F.when(a > 0, "complete").otherwise("undefined"),
        }
    )


def half_label(rank: Column) -> Column:
    """Half of an ordered replicate: 1 for odd positions, 2 for even."""
    return F.when(rank % 2 == 1, 1).otherwise(2)


def half_split(signals: DataFrame, cluster: str, order: str) -> DataFrame:
    """Correlation of the mean odd and mean even replicate per cluster.

    Replicates are numbered by a hash-free two-level rank (see ``ordered_rank``),
    and node means are partial sums, so a hot cluster never meets in one task.
    """
    from .ranks import ordered_rank

    r = ordered_rank(signals.select(cluster, order, "y"), [cluster], order)
    nodes = r.select(cluster, half_label(F.col("rank")).alias("_h"), F.posexplode("y").alias("i", "v"))
    means = nodes.groupBy(cluster, "i").agg(
        F.avg(F.when(F.col("_h") == 1, F.col("v"))).alias("a"),
        F.avg(F.when(F.col("_h") == 2, F.col("v"))).alias("b"),
    )
    return means.groupBy(cluster).agg(F.when(F.count("b") > 0, F.corr("a", "b")).alias("consistency"))


def detection_limits(df: DataFrame, keys: list[str]) -> DataFrame:
    """Calibration slope and the 3.3, 10 and 3 sigma limits; null for slope <= 0."""
    g = df.groupBy(*keys).agg(
        F.regr_slope("y_pred", "y_true").alias("slope"),
        F.regr_intercept("y_pred", "y_true").alias("intercept"),
        F.stddev_samp(F.when(F.col("is_blank"), F.col("y_pred"))).alias("sigma"),
    )
    return g.withColumns(
        {
            name: F.when(F.col("slope") > 0, k * F.col("sigma") / F.col("slope"))
            for name, k in (("ich_lod", 3.3), ("ich_loq", 10.0), ("iupac_lod", 3.0))
        }
    )
