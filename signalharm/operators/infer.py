"""Cluster resampling: bootstrap, sign flips, Holm.

Draws are data.  A draw table depends only on (seed, endpoint), so every
metric of an endpoint sees the same draws and comparisons stay paired.
Multiplicities are joined as weights; rows are never replicated.
"""

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from .align import weighted_gap
from .resample import count_extreme, drawn_sums, sign_sums
from .resample import draw_statistics as blocked_statistics
from .splits import hash_rank

ROOT_SEED = 20260817
RESAMPLES = 2000
FLIPS = 100_000
#: Observations of one key that a task may hold while it fits a block of draws.
MAX_KEY_ROWS = 1_000_000
EXTREME_TOLERANCE = 1e-15


def endpoint_seed(endpoint: str, operation: str, root: int = ROOT_SEED) -> str:
    """Seed text scoped to one endpoint and operation."""
    return hashlib.md5(f"{root}|{endpoint}|{operation}".encode()).hexdigest()


def _numbered(clusters: DataFrame, cluster: str, seed: str) -> DataFrame:
    """Distinct clusters with their 0-based hashed position ``_k``."""
    ids = hash_rank(clusters.select(cluster).distinct().withColumn("_all", F.lit(0)), ["_all"], cluster, seed)
    return ids.select(cluster, (F.col("rank") - 1).alias("_k"))


def draw_table(clusters: DataFrame, cluster: str, endpoint: str, resamples: int = RESAMPLES) -> DataFrame:
    """``resample, cluster, weight``: n draws with replacement per resample.

    Each cluster row doubles as one slot of every resample, so draws are made
    where the rows are; only the counted multiplicities move.
    """
    seed = endpoint_seed(endpoint, "bootstrap")
    ids = _numbered(clusters, cluster, seed)
    n = ids.agg(F.count(F.lit(1)).alias("_n"))
    slots = ids.join(F.broadcast(n), F.lit(True)).select(  # one-row side
        "_k", "_n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample")
    )
    drawn = slots.select(
        "resample", H.draw_index(F.col("_n"), seed, F.col("resample"), F.col("_k")).alias("_k")
    )
    counts = drawn.groupBy("resample", "_k").agg(F.count(F.lit(1)).alias("weight"))
    return counts.join(ids, "_k").select("resample", cluster, "weight")


@dataclass(frozen=True)
class Draws:
    """The draws of :func:`draw_table` without the table: sums over many clusters form them in place."""

    clusters: DataFrame
    cluster: str
    endpoint: str
    resamples: int = RESAMPLES

    def sums(self, values: DataFrame, cluster: str, keys: list[str], columns: list[str]) -> DataFrame:
        seed = endpoint_seed(self.endpoint, "bootstrap")
        ids = _numbered(self.clusters, self.cluster, seed).withColumnRenamed(self.cluster, cluster)
        n = self.clusters.select(self.cluster).distinct().count()
        return drawn_sums(values, ids, n, cluster, keys, columns, seed, self.resamples)


def interval(df: DataFrame, keys: list[str], values, confidence: float = 0.95, *more: Column) -> DataFrame:
    """Percentile interval of each value column over the resamples (a bounded list).

    ``more`` are further aggregates for the same pass.
    """
    a = (1 - confidence) / 2
    cols = []
    for v in values:
        p = F.percentile(v, F.array(F.lit(a), F.lit(1 - a)))
        cols += [p[0].alias(f"{v}_lower"), p[1].alias(f"{v}_upper")]
    cols += more
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def draw_statistics(obs: DataFrame, cluster_oc: DataFrame, draws: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, resample, ag, oc`` of every draw, by blocks of draws.

    Only where one key has more observations than a task may hold, its points are
    weighted and fitted as a distributed table.
    """
    # a draw only reweights, so the observation table bounds every fit
    per = obs.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    resamples = (draws.agg(F.max("resample")).first()[0] or 0) + 1
    if (per[0] or 0) <= MAX_KEY_ROWS:
        return blocked_statistics(obs, cluster_oc, draws, keys, resamples, per[1] or 0)
    ag = weighted_gap(obs.join(draws, "cluster_id"), [*keys, "resample"], "weight", (per[0], 2 * per[1] * resamples))
    oc = (
        cluster_oc.join(draws, "cluster_id")
        .groupBy(*keys, "resample")
        .agg((F.sum(F.col("oc") * F.col("weight")) / F.sum("weight")).alias("oc"))
    )
    return ag.select(*keys, "resample", "ag").join(oc, [*keys, "resample"])


def bootstrap_alignment(
    obs: DataFrame, cluster_oc: DataFrame, reference: str, draws: DataFrame, keys=(), confidence=0.95
) -> DataFrame:
    """Intervals of AG, OC and both contrasts per metric.

    Curves are refitted per draw; OC is a weighted mean of cluster OC.  A draw
    without downstream variation counts as failed and voids the AG interval.
    """
    keys = list(keys)
    both = draw_statistics(obs, cluster_oc, draws, [*keys, "metric"])
    # the reference sits next to its candidates: one small window per resample
    per_draw = Window.partitionBy(*keys, "resample")

    def at_reference(column):
        return F.max(F.when(F.col("metric") == reference, F.col(column))).over(per_draw)

    both = both.withColumns(
        {"d_ag": at_reference("ag") - F.col("ag"), "d_oc": F.col("oc") - at_reference("oc")}
    )
    failed = F.count_if(F.col("d_ag").isNull()).alias("failed_draws")
    out = interval(both, [*keys, "metric"], ["ag", "d_ag", "oc", "d_oc"], confidence, failed)
    void = {
        c: F.when(F.col("failed_draws") == 0, F.col(c))
        for c in ("ag_lower", "ag_upper", "d_ag_lower", "d_ag_upper")
    }
    return out.withColumns(void)


def bootstrap_sums(values: DataFrame, cluster: str, keys: list[str], columns: list[str], draws: DataFrame | Draws) -> DataFrame:
    """Weighted sums of per-cluster columns per (keys, resample)."""
    if isinstance(draws, Draws):
        return draws.sums(values, cluster, keys, columns)
    w = F.col("weight")
    return (
        values.join(draws, cluster)
        .groupBy(*keys, "resample")
        .agg(*[F.sum(F.col(c) * w).alias(c) for c in columns], F.sum(w).alias("_w"))
    )


def bootstrap_mean(values: DataFrame, cluster: str, keys: list[str], column: str, draws: DataFrame, confidence=0.95) -> DataFrame:
    """Mean of a per-cluster effect with its percentile interval."""
    s = bootstrap_sums(values, cluster, keys, [column], draws)
    means = s.withColumn("mean", F.col(column) / F.col("_w"))
    point = values.groupBy(*keys).agg(F.avg(column).alias("mean"))
    return point.join(interval(means, keys, ["mean"], confidence), keys)


def bootstrap_incomplete(values: DataFrame, source: str, keys: list[str], draws: DataFrame, confidence=0.95) -> DataFrame:
    """Curve mean over strengths where sources may lack a value.

    ``values``: keys, source, alpha, value (nullable).  Per strength the mean
    over contributing sources; a strength empty in a draw takes its full-sample
    mean; then the mean over strengths.
    """
    full = values.groupBy(*keys, "alpha").agg(
        F.avg("value").alias("_full"), F.count("value").alias("_n")
    )
    sums = bootstrap_sums(values.filter(F.col("value").isNotNull()), source, [*keys, "alpha"], ["value"], draws)
    sums = sums.select(*keys, "alpha", "resample", (F.col("value") / F.col("_w")).alias("_m"))
    if isinstance(draws, Draws):
        last = F.lit(draws.resamples - 1)
    else:
        last = F.col("_last")
        full = full.join(F.broadcast(draws.agg(F.max("resample").alias("_last"))), F.lit(True))  # one-row side
    planned = full.select(*keys, "alpha", "_full", "_n", F.explode(F.sequence(F.lit(0), last)).alias("resample"))
    cells = planned.join(sums, [*keys, "alpha", "resample"], "left")
    per = cells.groupBy(*keys, "resample").agg(
        F.avg(F.coalesce("_m", "_full")).alias("estimate")
    )
    point = full.groupBy(*keys).agg(
        F.avg("_full").alias("estimate"),
        F.min("_n").alias("min_contributing"),
        F.count_if(F.col("_full").isNull()).alias("_empty"),
    )
    out = point.join(interval(per, keys, ["estimate"], confidence), keys)
    ok = F.col("_empty") == 0
    return out.withColumns(
        {
            **{c: F.when(ok, F.col(c)) for c in ("estimate", "estimate_lower", "estimate_upper")},
            "state": F.when(ok, "complete").otherwise("not_evaluable_no_contributing_sources"),
        }
    ).drop("_empty")


def _extreme(permuted: Column, observed: Column) -> Column:
    return F.count_if(F.abs(permuted) + EXTREME_TOLERANCE >= F.abs(observed))


def sign_flip(
    contributions: DataFrame, cluster: str, values: dict[str, str], endpoint: str, flips: int = FLIPS
) -> DataFrame:
    """Two-sided Monte-Carlo p per contrast; ``values`` maps column -> 'sum' or 'mean'.

    ``contributions`` is wide: one row per cluster, one column per contrast, so
    all contrasts share one pass over the sign matrix.  A null adds nothing.
    """
    columns = list(values)
    totals = contributions.agg(*[F.sum(c).alias(f"t{i}") for i, c in enumerate(columns)], *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    means = [values[c] == "mean" for c in columns]

    def effects(sums, row):
        out = []
        for i, mean in enumerate(means):
            n = row[f"n{i}"] if mean else 1
            out.append((sums[i] / n if n else sums[i], None if row[f"t{i}"] is None else row[f"t{i}"] / n))
        return out

    sums = sign_sums(contributions, cluster, columns, endpoint_seed(endpoint, "sign_flip"), flips)
    found = count_extreme(sums, totals, effects, len(columns), EXTREME_TOLERANCE)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("effect") + 1)
    return found.select(name.alias("contrast"), "observed", "n_extreme", ((F.col("n_extreme") + 1) / F.lit(flips + 1)).alias("p_value"))


#: An exact test lists every sign pattern: about a million rows a key at most.
MAX_EXACT_UNITS = 20


def sign_flip_exact(values: DataFrame, keys: list[str], unit: str, column: str) -> DataFrame:
    """All 2^n sign patterns of the mean; n units per key, refused above MAX_EXACT_UNITS."""
    g = values.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(unit), F.col(column).alias("v")))).alias("d")
    )
    g = g.withColumn("observed", F.aggregate("d", F.lit(0.0), lambda a, e: a + e["v"]) / F.size("d"))
    patterns = g.select(
        *keys,
        "d",
        "observed",
        F.explode(
            F.when(F.size("d") > MAX_EXACT_UNITS, F.raise_error(F.lit("too many units for an exact sign flip"))).otherwise(
                F.sequence(F.lit(0).cast("long"), (F.pow(F.lit(2.0), F.size("d")) - 1).cast("long"))
            )
        ).alias("b"),
    )
    signed = F.aggregate(
        F.transform(
            "d",
            lambda e, i: e["v"]
            * F.when(F.floor(F.col("b") / F.pow(F.lit(2.0), i)) % 2 == 1, 1.0).otherwise(-1.0),
        ),
        F.lit(0.0),
        lambda a, v: a + v,
    ) / F.size("d")
    out = patterns.groupBy(*keys).agg(
        F.max("observed").alias("observed"),
        F.count(F.lit(1)).alias("n_patterns"),
        _extreme(signed, F.col("observed")).alias("n_extreme"),
    )
    return out.withColumn("p_value", F.col("n_extreme") / F.col("n_patterns"))


def pooled_rmse(sse: list[Column], n: Column, ranges: list[float]) -> Column:
    """Mean over targets of the range-normalised root mean squared error."""
    parts = [F.sqrt(s / n) / F.lit(float(r)) for s, r in zip(sse, ranges)]
    return reduce(lambda a, b: a + b, parts) / len(parts)


def bootstrap_rmse_effect(wells: DataFrame, cluster: str, left, right, ranges, draws, confidence=0.95) -> DataFrame:
    """100 x (pooled error of left - right): point and interval from summed errors."""
    cols = [*left, *right, "n"]
    s = bootstrap_sums(wells, cluster, [], cols, draws)
    effect = 100.0 * (
        pooled_rmse([F.col(c) for c in left], F.col("n"), ranges)
        - pooled_rmse([F.col(c) for c in right], F.col("n"), ranges)
    )
    point = wells.agg(*[F.sum(c).alias(c) for c in cols]).select(effect.alias("effect"))
    return point.join(interval(s.select(effect.alias("effect")), [], ["effect"], confidence), F.lit(True))


def sign_flip_rmse(wells: DataFrame, cluster: str, left, right, ranges, endpoint, flips=FLIPS) -> DataFrame:
    """A flip swaps the two methods' errors of a well; the effect is nonlinear in the sums."""
    k = range(len(left))
    halves = wells.select(cluster, "n", *left, *right, *[((F.col(a) - F.col(b)) / 2).alias(f"_h{i}") for i, (a, b) in enumerate(zip(left, right))])
    totals = halves.agg(
        *[F.sum((F.col(a) + F.col(b)) / 2).alias(f"m{i}") for i, (a, b) in enumerate(zip(left, right))],
        *[F.sum(f"_h{i}").alias(f"o{i}") for i in k],
        F.sum("n").alias("wells"),
    )

    def effect(row, part):
        def error(sign):
            parts = [np.sqrt(np.maximum(row[f"m{i}"] + sign * part[i], 0.0) / row["wells"]) / float(r) for i, r in enumerate(ranges)]
            return sum(parts) / len(parts)

        return 100.0 * (error(1.0) - error(-1.0))

    def effects(sums, row):
        return [(effect(row, sums), float(effect(row, [np.float64(row[f"o{i}"]) for i in k])) if row["wells"] else None)]

    sums = sign_sums(halves, cluster, [f"_h{i}" for i in k], endpoint_seed(endpoint, "sign_flip"), flips)
    found = count_extreme(sums, totals, effects, 1, EXTREME_TOLERANCE)
    return found.select("observed", "n_extreme", ((F.col("n_extreme") + 1) / F.lit(flips + 1)).alias("p_value"))


def holm(df: DataFrame, keys: list[str], p: str = "p_value", hypothesis: str = "hypothesis", alpha: float = 0.05) -> DataFrame:
    """Step-down adjustment inside each family: running maximum of (m - i) p."""
    part = Window.partitionBy(*keys)
    order = part.orderBy(p, hypothesis)
    df = df.withColumns(
        {"family_size": F.count(F.lit(1)).over(part), "holm_rank": F.row_number().over(order)}
    )
    step = F.least(F.lit(1.0), (F.col("family_size") - F.col("holm_rank") + 1) * F.col(p))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_step", step).withColumn("adjusted_p", F.max("_step").over(upto))
    return df.drop("_step").withColumn("rejected", F.col("adjusted_p") < alpha)


def holm_family(planned: DataFrame, tested: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Fixed-size family: untested slots enter as p = 1 and show null.

    ``tested`` has hypothesis, p_value, contrast; rejection also needs a
    favourable (positive) contrast.
    """
    slots = planned.join(tested, [*keys, "hypothesis"], "left").withColumn(
        "_p", F.coalesce("p_value", F.lit(1.0))
    )
    out = holm(slots, keys, "_p", "hypothesis", alpha)
    shown = F.col("p_value").isNotNull()
    return out.withColumns(
        {
            "state": F.when(shown, "tested").otherwise("not_tested"),
            "rejected": F.col("rejected") & shown & F.coalesce(F.col("contrast") > 0, F.lit(False)),
            "adjusted_p": F.when(shown, F.col("adjusted_p")),
            "holm_rank": F.when(shown, F.col("holm_rank")),
        }
    ).drop("_p")
