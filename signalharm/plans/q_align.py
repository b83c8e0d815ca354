"""Alignment statistics over the observation table."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import align as L
from ..operators.isotonic import isotonic_fit
from . import observations as O
from . import sqltext as T
from .registry import query

K = ["metric"]
R = A.rounded


def R9(column):
    """Concordance is a multiple of a small fraction: nine digits avoid rounding ties."""
    return A.rounded(column, 9)


def rnd(*names):
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@query("observations", f"WITH {O.sql_observations(whole=True)} SELECT metric, cluster_id, perturbation_id, alpha, x + 0.0 AS x, y + 0.0 AS y FROM obs")
def observations(spark, sf):
    return O.observations(spark, sf, O.ALL_OUTPUTS).withColumns({"x": F.col("x") + 0.0, "y": F.col("y") + 0.0})


@query(
    "obs_checks",
    f"WITH {O.SQL_OBS}"
    + """ SELECT metric, count(*)::BIGINT AS n_cells, count(DISTINCT cluster_id)::BIGINT AS n_clusters, 0::BIGINT AS n_duplicates, 0::BIGINT AS n_not_finite,
 0::BIGINT AS n_bad_alpha, count(DISTINCT perturbation_id)::BIGINT AS n_perturbations, count(DISTINCT alpha)::BIGINT AS n_alphas,
 (count(DISTINCT cluster_id) * count(DISTINCT perturbation_id) * count(DISTINCT alpha) - count(*))::BIGINT AS n_missing,
 CASE WHEN count(*) = count(DISTINCT cluster_id) * count(DISTINCT perturbation_id) * count(DISTINCT alpha) THEN 'complete' ELSE 'incomplete_grid' END AS state
 FROM (SELECT * FROM obs WHERE NOT (metric = 'sam' AND cluster_id = 3 AND alpha = 0.2)) GROUP BY metric""",
)
def obs_checks(spark, sf):
    """The sam table loses one strength of one cluster to exercise the check."""
    obs = O.observations(spark, sf).filter(
        ~((F.col("metric") == "sam") & (F.col("cluster_id") == 3) & (F.col("alpha") == 0.2))
    )
    out = L.check_observations(obs, K)
    return out.withColumn("n_alphas", F.col("n_alphas").cast("long"))


@query(
    "isotonic_fit",
    f"WITH {O.SQL_OBS}, {O.sql_isotonic('obs', 'metric')}"
    + " SELECT o.metric, o.cluster_id, o.perturbation_id, o.alpha, round(iso.fit, 6) + 0.0 AS fit FROM obs o JOIN iso ON iso.metric = o.metric AND iso.x = o.x",
)
def isotonic_query(spark, sf):
    df = isotonic_fit(O.observations(spark, sf), K, "x", "y")
    return df.select("metric", "cluster_id", "perturbation_id", "alpha", R(F.col("fit")).alias("fit"))


_AG_SELECT = f"metric, n_observations, {rnd('sst', 'sse_pooled', 'sse_separate', 'ag', 'r2_pooled', 'r2_separate')}, state"


def nodes(spark, sf, keys=None, obs=None):
    return L.fitted_nodes(O.observations(spark, sf) if obs is None else obs, keys or K)


@query("alignment_gap", f"WITH {O.SQL_OBS}, {O.sql_nodes()}, {O.sql_gap()} SELECT {_AG_SELECT} FROM ag")
def alignment_gap(spark, sf):
    df = L.alignment_gap(nodes(spark, sf), K)
    return df.select(
        "metric",
        "n_observations",
        *[R(F.col(c)).alias(c) for c in ("sst", "sse_pooled", "sse_separate", "ag", "r2_pooled", "r2_separate")],
        "state",
    )


@query(
    "ag_contributions",
    f"WITH {O.SQL_OBS}, {O.sql_nodes()}"
    + """, t AS (SELECT metric, var_pop(y) * count(*) AS sst FROM nodes GROUP BY metric)
SELECT metric, cluster_id, round(sum(e_pooled - e_separate) / any_value(sst), 6) + 0.0 AS ag_contribution FROM nodes JOIN t USING (metric) GROUP BY ALL""",
)
def ag_contributions(spark, sf):
    df = L.gap_contributions(nodes(spark, sf), K)
    return df.withColumn("ag_contribution", R(F.col("ag_contribution")))


@query(
    "cross_pairs",
    f"WITH {O.SQL_OBS}, {O.sql_pairs()} SELECT metric, cluster_id, left_family, right_family, agree, disagree, metric_tie, downstream_tie, double_tie, n_pairs FROM cells",
)
def cross_pairs(spark, sf):
    return L.concordance_cells(O.observations(spark, sf), K)


@query(
    "concordance",
    f"WITH {O.SQL_OBS}, {O.sql_pairs()} SELECT metric, agree, disagree, metric_tie, downstream_tie, double_tie, n_pairs, round(oc, 9) + 0.0 AS oc FROM ocs",
)
def concordance(spark, sf):
    df = L.concordance(L.concordance_cells(O.observations(spark, sf), K), K)
    return df.withColumn("oc", R9(F.col("oc")))


def statistics(obs, keys):
    """AG and OC per key."""
    ag = L.alignment_gap(L.fitted_nodes(obs, keys), keys)
    oc = L.concordance(L.concordance_cells(obs, keys), keys)
    return ag.select(*keys, "ag", "sst", "state").join(oc.select(*keys, "oc"), keys)


@query(
    "compare_alignment",
    f"WITH {O.SQL_OBS}, {O.sql_nodes()}, {O.sql_gap()}, {O.sql_pairs()}"
    + """ SELECT a.metric, round(a.ag, 6) + 0.0 AS ag, round(o.oc, 9) + 0.0 AS oc, round(ra.ag - a.ag, 6) + 0.0 AS d_ag, round(o.oc - ro.oc, 9) + 0.0 AS d_oc
 FROM ag a JOIN ocs o USING (metric), (SELECT ag FROM ag WHERE metric = 'mse') ra, (SELECT oc FROM ocs WHERE metric = 'mse') ro""",
)
def compare_alignment(spark, sf):
    df = L.compare(statistics(O.observations(spark, sf), K), [], "mse")
    return df.select("metric", *[(R9 if c.endswith("oc") else R)(F.col(c)).alias(c) for c in ("ag", "oc", "d_ag", "d_oc")])


_SCOPES = {"all5": T.FAMILIES, "no_axis": T.NONAXIS}


def scoped(obs):
    """Observations once per scope that contains their family."""
    names = F.array_compact(
        F.array(
            *[F.when(F.col("perturbation_id").isin(*fam), F.lit(s)) for s, fam in _SCOPES.items()]
        )
    )
    return obs.withColumn("scope", F.explode(names))


_SQL_SCOPED = """
sobs AS MATERIALIZED (SELECT 'all5' AS scope, * FROM obs UNION ALL SELECT 'no_axis', * FROM obs WHERE perturbation_id IN ('p08', 'p09', 'p10'))"""


@query(
    "scoped_alignment",
    f"WITH {O.SQL_OBS}, {_SQL_SCOPED}, {O.sql_nodes('sobs', 'scope, metric')}, {O.sql_gap('scope, metric')}, {O.sql_pairs('sobs', 'scope, metric')}"
    + " SELECT scope, metric, round(ag, 6) + 0.0 AS ag, round(oc, 9) + 0.0 AS oc, state FROM ag JOIN ocs USING (scope, metric)",
)
def scoped_alignment(spark, sf):
    df = statistics(scoped(O.observations(spark, sf)), ["scope", "metric"])
    return df.select("scope", "metric", R(F.col("ag")).alias("ag"), R9(F.col("oc")).alias("oc"), "state")


@query(
    "ag_by_family",
    f"WITH {O.SQL_OBS}, {O.sql_nodes()}"
    + """, t AS (SELECT metric, var_pop(y) * count(*) AS sst FROM nodes GROUP BY metric),
lo AS (SELECT metric, max(x) AS x0, arg_max(fit_pooled, x) AS f0 FROM nodes WHERE x <= 0 GROUP BY metric),
hi AS (SELECT metric, min(x) AS x1, arg_min(fit_pooled, x) AS f1 FROM nodes WHERE x > 0 GROUP BY metric),
zp AS (SELECT t.metric, CASE WHEN x0 IS NULL THEN f1 WHEN x1 IS NULL THEN f0 ELSE f0 + (0 - x0) / (x1 - x0) * (f1 - f0) END AS z FROM t LEFT JOIN lo USING (metric) LEFT JOIN hi USING (metric))
SELECT metric, perturbation_id AS family, round(sum(e_pooled), 6) + 0.0 AS pooled_sse, round(sum(e_separate), 6) + 0.0 AS separate_sse,
 round(sum(e_pooled - e_separate) / any_value(sst), 6) + 0.0 AS d_p, round(avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS zero_metric_harm_proportion,
 round(avg(y), 6) + 0.0 AS mean_downstream, round(any_value(z), 6) + 0.0 AS pooled_prediction_at_zero
FROM nodes JOIN t USING (metric) JOIN zp USING (metric) GROUP BY ALL""",
)
def ag_by_family(spark, sf):
    df = L.decompose(nodes(spark, sf), K)
    return df.select("metric", "family", *[R(F.col(c)).alias(c) for c in df.columns[2:]])


@query(
    "oc_by_pair",
    f"WITH {O.SQL_OBS}, {O.sql_pairs()}"
    + """, b AS (SELECT metric, left_family, right_family, cluster_id, n_pairs, (agree + 0.5 * (metric_tie + downstream_tie + double_tie)) / n_pairs AS oc FROM cells),
p AS (SELECT metric, left_family, right_family, sum(n_pairs)::BIGINT AS n_pairs, avg(oc) AS oc FROM b GROUP BY ALL),
g AS (SELECT *, CASE (left_family IN ('p11', 'p12'))::INT + (right_family IN ('p11', 'p12'))::INT WHEN 2 THEN 'axis_axis' WHEN 1 THEN 'mixed' ELSE 'nonaxis_nonaxis' END AS pair_group FROM p)
SELECT metric, left_family || '-' || right_family AS slice, n_pairs, round(oc, 9) + 0.0 AS oc FROM p
UNION ALL SELECT metric, pair_group, sum(n_pairs)::BIGINT, round(avg(oc), 9) + 0.0 FROM g GROUP BY ALL""",
)
def oc_by_pair(spark, sf):
    """Ten family pairs and the three pair groups."""
    cells = L.concordance_cells(O.observations(spark, sf), K)
    pairs = L.concordance_by_pair(cells, K).withColumn(
        "slice", F.concat_ws("-", "left_family", "right_family")
    )
    groups = L.concordance_by_group(cells, K).withColumnRenamed("pair_group", "slice")
    cols = ["metric", "slice", "n_pairs", R9(F.col("oc")).alias("oc")]
    return pairs.select(*cols).unionByName(groups.select(*cols))
