"""Alignment of metric harm (x) with downstream harm (y).

Observation tables have one row per (keys.., cluster_id, perturbation_id,
alpha) with x and y.  ``keys`` usually is the metric, plus panel, scope or
resample; every statistic below is one plan over all keys at once.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .isotonic import isotonic_fit, points, pools

TOLERANCE = 1e-12
POOLED = "*"


def check_observations(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: duplicates, grid completeness, strength support, finiteness."""
    cells = obs.groupBy(*keys, "cluster_id", "perturbation_id", "alpha").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(
            F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y")
        ).alias("bad"),
    )
    supports = cells.groupBy(*keys, "perturbation_id").agg(
        F.sort_array(F.collect_set("alpha")).alias("grid")
    )
    grids = supports.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_perturbations"),
        F.count_distinct("grid").alias("n_grids"),
        F.min(F.size("grid")).alias("n_alphas"),
    )
    counts = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_distinct("cluster_id").alias("n_clusters"),
        F.sum(F.col("n") - 1).alias("n_duplicates"),
        F.sum("bad").alias("n_not_finite"),
        F.count_if(F.col("alpha") <= 0).alias("n_bad_alpha"),
    )
    expected = F.col("n_clusters") * F.col("n_perturbations") * F.col("n_alphas")
    state = (
        F.when(F.col("n_duplicates") > 0, "duplicate_condition")
        .when(F.col("n_perturbations") < 2, "too_few_perturbations")
        .when((F.col("n_grids") > 1) | (F.col("n_alphas") < 2), "strength_support_differs")
        .when(F.col("n_cells") != expected, "incomplete_grid")
        .when(F.col("n_not_finite") > 0, "not_finite")
        .when(F.col("n_bad_alpha") > 0, "strength_not_positive")
        .otherwise("complete")
    )
    return counts.join(grids, keys).withColumns(
        {"n_missing": expected - F.col("n_cells"), "state": state}
    ).drop("n_grids")


def _both_scopes(obs: DataFrame) -> DataFrame:
    """Each row once for the pooled curve and once for its perturbation's curve."""
    return obs.withColumn("part", F.explode(F.array(F.lit(POOLED), F.col("perturbation_id"))))


def fitted_nodes(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Observations with the squared residual of both curves (``e_pooled``, ``e_separate``)."""
    long = _both_scopes(obs)
    fit = isotonic_fit(long, [*keys, "part"], "x", "y")
    error = (F.col("y") - F.col("fit")) * (F.col("y") - F.col("fit"))
    pooled = F.col("part") == POOLED
    return fit.groupBy(*keys, "cluster_id", "perturbation_id", "alpha", "x", "y").agg(
        F.max(F.when(pooled, F.col("fit"))).alias("fit_pooled"),
        F.max(F.when(~pooled, F.col("fit"))).alias("fit_separate"),
        F.max(F.when(pooled, error)).alias("e_pooled"),
        F.max(F.when(~pooled, error)).alias("e_separate"),
    )


def _gap_columns(sst, pooled, separate, constant) -> dict[str, Column]:
    raw = (pooled - separate) / sst
    ok = sst > 0
    return {
        "ag": F.when(ok & constant, 0.0)
        .when(ok & (raw < 0) & (raw >= -TOLERANCE), 0.0)
        .when(ok, raw),
        "r2_pooled": F.when(ok, 1 - pooled / sst),
        "r2_separate": F.when(ok, 1 - separate / sst),
        "state": F.when(~ok, "constant_downstream")
        .when(constant, "constant_metric")
        .otherwise("complete"),
    }


def alignment_gap(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """AG per key from :func:`fitted_nodes`: what one curve loses to one per perturbation.

    A metric that never moves carries no ordering and gets AG 0.
    """
    g = nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_observations"),
        (F.var_pop("y") * F.count("y")).alias("sst"),
        F.sum("e_pooled").alias("sse_pooled"),
        F.sum("e_separate").alias("sse_separate"),
        (F.min("x") == F.max("x")).alias("_constant"),
    )
    return g.withColumns(
        _gap_columns(F.col("sst"), F.col("sse_pooled"), F.col("sse_separate"), F.col("_constant"))
    ).drop("_constant")


def gap_contributions(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per cluster share of the gap; shares add up to AG."""
    sst = nodes.groupBy(*keys).agg(
        (F.var_pop("y") * F.count("y")).alias("sst"), (F.min("x") == F.max("x")).alias("_c")
    )
    part = nodes.groupBy(*keys, "cluster_id").agg(
        F.sum(F.col("e_pooled") - F.col("e_separate")).alias("_d")
    )
    value = F.when(F.col("sst") > 0, F.when(F.col("_c"), 0.0).otherwise(F.col("_d") / F.col("sst")))
    return part.join(sst, keys).select(*keys, "cluster_id", value.alias("ag_contribution"))


def weighted_gap(obs: DataFrame, keys: list[str], weight: str, sizes=None, constant: float = 1e-13) -> DataFrame:
    """AG per key with observation weights, from sums only (used inside resampling).

    A key whose centred sum of squares is within ``constant`` of its raw sum of
    squares counts as constant: centre an outcome with a large mean first.

    ``sizes`` bounds (points per key, points in all) where the caller knows them.
    """
    blocks = pools(points(_both_scopes(obs), [*keys, "part"], "x", "y", weight), [*keys, "part"], sizes=sizes)
    pooled = F.col("part") == POOLED
    error = F.col("swyy") - F.col("swy") * F.col("swy") / F.col("sw")

    def over_all(column):
        return F.sum(F.when(pooled, F.col(column)))

    g = blocks.groupBy(*keys).agg(
        F.sum(F.when(pooled, error)).alias("sse_pooled"),
        F.sum(F.when(~pooled, error)).alias("sse_separate"),
        over_all("swyy").alias("_yy"),
        (over_all("swyy") - over_all("swy") * over_all("swy") / over_all("sw")).alias("_sst"),
        (F.min("x_lo") == F.max("x_hi")).alias("_constant"),
    )
    # a difference of sums: below rounding level the downstream harm is constant
    g = g.withColumn("sst", F.when(F.col("_sst") > constant * F.col("_yy"), F.col("_sst")).otherwise(0.0))
    return g.withColumns(
        _gap_columns(F.col("sst"), F.col("sse_pooled"), F.col("sse_separate"), F.col("_constant"))
    ).drop("_yy", "_sst", "_constant")


COUNTS = ("agree", "disagree", "metric_tie", "downstream_tie", "double_tie")


def _count_pairs(left, right) -> Column:
    """Five exclusive counts over left x right; the lists are one cluster's conditions."""

    def add(acc, a, b):
        dx, dy = a["x"] - b["x"], a["y"] - b["y"]
        kind = (
            F.when((dx == 0) & (dy == 0), 4)
            .when(dx == 0, 2)
            .when(dy == 0, 3)
            .when((dx > 0) == (dy > 0), 0)
            .otherwise(1)
        )
        return A.let(
            kind,
            lambda k: F.struct(
                *[
                    (acc[c] + F.when(k == i, 1).otherwise(0)).cast("long").alias(c)
                    for i, c in enumerate(COUNTS)
                ]
            ),
        )

    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    return A.lets(
        {"l": left, "r": right},
        lambda s: F.aggregate(
            s["l"],
            zero,
            lambda acc, a: F.aggregate(s["r"], acc, lambda inner, b: add(inner, a, b)),
        ),
    )


def concordance_cells(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Pair counts per (keys, cluster, left family, right family).

    A cluster's conditions form one array, bounded by the design grid, and the
    pairs are counted inside the row, never emitted.
    """
    rows = obs.groupBy(*keys, "cluster_id", "perturbation_id").agg(
        F.collect_list(F.struct("x", "y")).alias("c")
    )
    families = rows.groupBy(*keys, "cluster_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("perturbation_id").alias("p"), "c"))).alias("f")
    )
    pairs = F.flatten(
        F.transform(
            "f",
            lambda a, i: F.transform(
                F.filter("f", lambda b: b["p"] > a["p"]),
                lambda b: F.struct(
                    a["p"].alias("left_family"),
                    b["p"].alias("right_family"),
                    _count_pairs(a["c"], b["c"]).alias("n"),
                ),
            ),
        )
    )
    return (
        families.select(*keys, "cluster_id", F.explode(pairs).alias("q"))
        .select(*keys, "cluster_id", "q.left_family", "q.right_family", "q.n.*")
        .withColumn("n_pairs", sum((F.col(c) for c in COUNTS), F.lit(0)))
    )


def score(prefix: str = "") -> Column:
    """Agreement 1, any tie one half."""
    c = {k: F.sum(prefix + k) for k in (*COUNTS, "n_pairs")}
    ties = c["metric_tie"] + c["downstream_tie"] + c["double_tie"]
    return (c["agree"] + 0.5 * ties) / c["n_pairs"]


def cluster_concordance(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, "cluster_id").agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "n_pairs")], score().alias("oc")
    )


def concordance(cells: DataFrame, keys: list[str]) -> DataFrame:
    """OC per key: mean over clusters of the per-cluster score."""
    return cluster_concordance(cells, keys).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "n_pairs")], F.avg("oc").alias("oc")
    )


PAIR_GROUP = (
    ("axis_axis", 2),
    ("mixed", 1),
    ("nonaxis_nonaxis", 0),
)


def concordance_by_pair(cells: DataFrame, keys: list[str]) -> DataFrame:
    per = cells.groupBy(*keys, "left_family", "right_family", "cluster_id").agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "n_pairs")], score().alias("oc")
    )
    return per.groupBy(*keys, "left_family", "right_family").agg(
        *[F.sum(c).alias(c) for c in (*COUNTS, "n_pairs")], F.avg("oc").alias("oc")
    )


def concordance_by_group(cells: DataFrame, keys: list[str], axis_families=("p11", "p12")) -> DataFrame:
    """Pair groups non-axis / mixed / axis, each the mean over its family pairs."""
    n_axis = F.col("left_family").isin(*axis_families).cast("int") + F.col("right_family").isin(
        *axis_families
    ).cast("int")
    name = F.lit(None).cast("string")
    for label, k in PAIR_GROUP:
        name = F.when(n_axis == k, label).otherwise(name)
    per = concordance_by_pair(cells, keys)
    return per.withColumn("pair_group", name).groupBy(*keys, "pair_group").agg(
        F.sum("n_pairs").alias("n_pairs"), F.avg("oc").alias("oc")
    )


def compare(stats: DataFrame, keys: list[str], reference: str, metric: str = "metric") -> DataFrame:
    """Contrast every metric with the reference: positive favours the candidate.

    ``d_ag = AG(ref) - AG(cand)``, ``d_oc = OC(cand) - OC(ref)``.
    """
    ref = stats.filter(F.col(metric) == reference).select(
        *keys, F.col("ag").alias("_ag"), F.col("oc").alias("_oc")
    )
    # one reference row per key; without keys a single row
    joined = stats.join(ref, keys) if keys else stats.join(F.broadcast(ref), F.lit(True))
    return joined.withColumns(
        {"d_ag": F.col("_ag") - F.col("ag"), "d_oc": F.col("oc") - F.col("_oc")}
    ).drop("_ag", "_oc")


def decompose(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Gap per perturbation family with its curve errors and zero-harm share."""
    sst = nodes.groupBy(*keys).agg(
        (F.var_pop("y") * F.count("y")).alias("sst"),
        # pooled prediction at x = 0: last fit at or below zero, else the first
        F.coalesce(
            F.max_by(F.when(F.col("x") <= 0, F.col("fit_pooled")), F.when(F.col("x") <= 0, F.col("x"))),
            F.min_by("fit_pooled", "x"),
        ).alias("_below"),
        F.min(F.when(F.col("x") > 0, F.col("x"))).alias("_x1"),
        F.min_by(F.when(F.col("x") > 0, F.col("fit_pooled")), F.when(F.col("x") > 0, F.col("x"))).alias("_f1"),
        F.max(F.when(F.col("x") <= 0, F.col("x"))).alias("_x0"),
    )
    at_zero = F.when(F.col("_x0").isNull() | F.col("_x1").isNull(), F.col("_below")).otherwise(
        F.col("_below")
        + (0 - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_f1") - F.col("_below"))
    )
    per = nodes.groupBy(*keys, F.col("perturbation_id").alias("family")).agg(
        F.sum("e_pooled").alias("pooled_sse"),
        F.sum("e_separate").alias("separate_sse"),
        F.avg(F.when(F.col("x") == 0, 1.0).otherwise(0.0)).alias("zero_metric_harm_proportion"),
        F.avg("y").alias("mean_downstream"),
    )
    return per.join(sst.withColumn("pooled_prediction_at_zero", at_zero), keys).select(
        *keys,
        "family",
        "pooled_sse",
        "separate_sse",
        F.when(F.col("sst") > 0, (F.col("pooled_sse") - F.col("separate_sse")) / F.col("sst")).alias("d_p"),
        "zero_metric_harm_proportion",
        "mean_downstream",
        "pooled_prediction_at_zero",
    )


def rank_stability(df: DataFrame, keys: list[str], left: str, right: str, smaller_is_better: bool) -> DataFrame:
    """Average ranks, Kendall tau-b and largest displacement of two score columns.

    ``df`` has one row per (keys, metric): lists are bounded by the registry.
    """
    sign = 1.0 if smaller_is_better else -1.0
    g = df.groupBy(*keys).agg(
        F.collect_list(F.struct((sign * F.col(left)).alias("a"), (sign * F.col(right)).alias("b"))).alias("v"),
        F.count_if(F.col(left).isNull() | F.col(right).isNull()).alias("_missing"),
    )

    def rank(name):
        return lambda s: F.transform(
            s,
            lambda p: F.size(F.filter(s, lambda q: q[name] < p[name]))
            + (F.size(F.filter(s, lambda q: q[name] == p[name])) + 1) / 2.0,
        )

    def pair_sum(fn):
        return lambda s: F.aggregate(
            s,
            F.lit(0.0),
            lambda acc, p: acc + F.aggregate(s, F.lit(0.0), lambda i, q: i + fn(p, q)),
        )

    def sgn(p, q, n):
        return F.signum(p[n] - q[n])

    s = F.col("v")
    ties = lambda n: F.size(s) - F.size(F.array_distinct(F.transform(s, lambda p: p[n])))
    g = A.pin(
        g,
        {
            "ra": A.let(s, rank("a")),
            "rb": A.let(s, rank("b")),
            "num": A.let(s, pair_sum(lambda p, q: sgn(p, q, "a") * sgn(p, q, "b"))),
            "na": A.let(s, pair_sum(lambda p, q: F.abs(sgn(p, q, "a")))),
            "nb": A.let(s, pair_sum(lambda p, q: F.abs(sgn(p, q, "b")))),
            "left_ties": ties("a"),
            "right_ties": ties("b"),
        },
    )
    tau = F.when(
        (F.col("na") > 0) & (F.col("nb") > 0) & (F.col("_missing") == 0),
        F.col("num") / F.sqrt(F.col("na") * F.col("nb")),
    )
    return g.select(
        *keys,
        tau.alias("tau_b"),
        "left_ties",
        "right_ties",
        F.array_max(F.zip_with("ra", "rb", lambda a, b: F.abs(a - b))).alias("max_displacement"),
        F.coalesce(tau > 0.9, F.lit(False)).alias("stable"),
        F.when(F.col("_missing") > 0, "not_evaluable_incomplete_metric_set")
        .when(tau.isNull(), "not_evaluable_all_tied_ranking")
        .otherwise("complete_numeric")
        .alias("state"),
    )


def decision_profile(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """favourable / adverse / unresolved per statistic and the joint verdict.

    ``adjusted_ag`` and ``adjusted_oc`` are family-wise adjusted p-values: a
    verdict needs a rejection inside its Holm family and the sign of the contrast.
    """

    def verdict(contrast, p):
        return (
            F.when((F.col(p) < alpha) & (F.col(contrast) > 0), "favourable")
            .when((F.col(p) < alpha) & (F.col(contrast) < 0), "adverse")
            .otherwise("unresolved")
        )

    df = df.withColumns({"ag_verdict": verdict("d_ag", "adjusted_ag"), "oc_verdict": verdict("d_oc", "adjusted_oc")})
    ag, oc = F.col("ag_verdict") == "favourable", F.col("oc_verdict") == "favourable"
    return df.withColumn(
        "profile",
        F.when(ag & oc, "joint").when(ag, "ag_only").when(oc, "oc_only").otherwise("none"),
    )


