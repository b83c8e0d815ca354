"""Task queries: identification, reports, harms, contrasts between protocols."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.measures import MEASURES, Pair
from ..operators import align as L
from ..operators import audit as U
from ..operators import measure as M
from ..operators import signals as S
from ..operators import tasks
from ..operators.perturb import perturb
from ..operators.quantiles import exact_quantiles
from . import observations as O
from . import sqltext as T
from .q_align import K, statistics
from .q_infer import HOLM_SQL, REF, SQL_FLIP, N_FLIPS, contrast_columns, wells, _WELLS
from .q_measures import pair
from .q_splits import _EMB, SQL_QUERY_LIBRARY
from .registry import query
from .tables import signals, table
from ..operators import infer as I

R = A.rounded
OUT = ["seed", "signal_id", "perturbation_id", "alpha"]

# -- clean identification ------------------------------------------------------


def clean_scores(spark, sf):
    """Best score and member per (seed, query, class) on unperturbed signals."""
    roles = O.split(spark, sf)
    v = A.pin(signals(spark, sf), {"v": A.l2_normalize(F.col("y"))})
    v = v.select("signal_id", "class_id", "group_id", "v").join(roles, ["class_id", "group_id"])
    q = v.filter(F.col("role") == "query").withColumnRenamed("class_id", "true_class")
    lib = v.filter(F.col("role") == "library").withColumnRenamed("signal_id", "lib_id")
    return tasks.class_scores(q, lib, ["seed"], ["signal_id", "true_class"])


_CLEAN = f"""{T.SQL_SIGNALS}, {_EMB}, {SQL_QUERY_LIBRARY},
nv AS MATERIALIZED (SELECT signal_id, class_id, group_id, list(y ORDER BY i) AS v, sqrt(sum(y * y)) AS nv FROM sig GROUP BY ALL),
sc AS (SELECT rq.seed, q.signal_id, q.class_id AS true_class, l.class_id, l.signal_id AS lib_id,
   round(greatest(-1.0, least(1.0, list_dot_product(q.v, l.v) / (q.nv * l.nv))), 12) AS score
  FROM nv q JOIN ql rq ON rq.class_id = q.class_id AND rq.group_id = q.group_id AND rq.role = 'query'
  JOIN ql rl ON rl.seed = rq.seed AND rl.role = 'library' JOIN nv l ON l.class_id = rl.class_id AND l.group_id = rl.group_id),
bc AS MATERIALIZED (SELECT seed, signal_id, true_class, class_id, max(score) AS score, arg_min(lib_id, (-score, lib_id)) AS lib_id FROM sc GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY seed, signal_id ORDER BY score DESC, class_id) AS rank FROM bc),
tr AS (SELECT seed, signal_id, true_class, max(class_id) FILTER (rank = 1) AS predicted_class, max(rank) FILTER (class_id = true_class) AS true_rank FROM cr GROUP BY ALL)"""


@query(
    "cosine_pairs",
    f"WITH {_CLEAN} SELECT seed::BIGINT AS seed, signal_id, lib_id, round(score, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY seed, signal_id ORDER BY score DESC, lib_id) AS k FROM bc) WHERE k = 1",
)
def cosine_pairs(spark, sf):
    """Nearest library member of every query."""
    s = clean_scores(spark, sf)
    best = F.max(F.struct("score", (-F.col("lib_id")).alias("m")))
    return s.groupBy("seed", "signal_id").agg(best.alias("b")).select(
        F.col("seed").cast("long").alias("seed"),
        "signal_id",
        (-F.col("b.m")).alias("lib_id"),
        R(F.col("b.score")).alias("score"),
    )


def clean_ranks(spark, sf):
    return tasks.rank_classes(clean_scores(spark, sf), ["seed", "signal_id"])


@query(
    "class_rank",
    f"WITH {_CLEAN} SELECT seed::BIGINT AS seed, signal_id, class_id, round(score, 6) + 0.0 AS score, rank::BIGINT AS rank FROM cr",
)
def class_rank(spark, sf):
    return clean_ranks(spark, sf).select(
        F.col("seed").cast("long").alias("seed"),
        "signal_id",
        "class_id",
        R(F.col("score")).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    "topk_hit",
    f"WITH {_CLEAN} SELECT seed::BIGINT AS seed, count(*)::BIGINT AS n, count_if(true_rank = 1)::BIGINT AS n_top1, count_if(true_rank <= 5)::BIGINT AS n_top5 FROM tr GROUP BY seed",
)
def topk_hit(spark, sf):
    t = tasks.topk(clean_ranks(spark, sf), ["seed", "signal_id"])
    return t.groupBy(F.col("seed").cast("long").alias("seed")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("top1").alias("n_top1"), F.count_if("topk").alias("n_top5")
    )


@query(
    "library_match",
    f"WITH {_CLEAN} SELECT seed::BIGINT AS seed, signal_id, true_class, predicted_class, true_rank::BIGINT AS true_rank FROM tr",
)
def library_match(spark, sf):
    t = tasks.topk(clean_ranks(spark, sf), ["seed", "signal_id"])
    return t.select(
        F.col("seed").cast("long").alias("seed"),
        "signal_id",
        "true_class",
        "predicted_class",
        F.col("true_rank").cast("long").alias("true_rank"),
    )


# -- perturbed identification ---------------------------------------------------


def _match(key, adapted):
    sql = (
        f"WITH {O.SQL_TASK}, {O.sql_scores(adapted)} SELECT perturbation_id, alpha, count(*)::BIGINT AS n, "
        "count_if(true_rank = 1)::BIGINT AS n_top1, count_if(true_rank <= 5)::BIGINT AS n_top5 FROM oc GROUP BY ALL"
    )

    @query(key, sql)
    def run(spark, sf):
        return O.outcomes(spark, sf, adapted).groupBy("perturbation_id", "alpha").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("top1").alias("n_top1"),
            F.count_if("topk").alias("n_top5"),
        )


_match("match_fixed", False)
_match("match_adapted", True)

SQL_FIXED = f"{O.SQL_TASK}, {O.sql_scores()}"
_REPORT = """
pcl AS (SELECT {k} s.class_id, count_if(s.true_class = s.class_id) AS support, count_if(s.predicted_class = s.class_id) AS predicted,
  count_if(s.true_class = s.class_id AND s.predicted_class = s.class_id) AS tp FROM (SELECT oc.*, c.class_id FROM oc, (SELECT DISTINCT true_class AS class_id FROM oc) c) s GROUP BY ALL),
pcm AS (SELECT *, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM pcl WHERE support + predicted > 0)"""


@query(
    "class_report",
    f"WITH {SQL_FIXED}, {_REPORT.format(k='')}"
    + " SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1 FROM pcm",
)
def class_report(spark, sf):
    per = tasks.class_metrics(tasks.confusion(O.outcomes(spark, sf), [], "true_class", "predicted_class"), [])
    df = tasks.classification_report(per, [])
    return df.select("n", *[R(F.col(c)).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")])


@query(
    "condition_summary",
    f"WITH {SQL_FIXED}, {_REPORT.format(k='s.perturbation_id, s.alpha,')}"
    + """ SELECT perturbation_id, alpha, sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS micro_accuracy, round(avg(recall) FILTER (support > 0), 6) AS macro_accuracy,
 round(avg(f1), 6) AS macro_f1 FROM pcm GROUP BY ALL""",
)
def condition_summary(spark, sf):
    keys = ["perturbation_id", "alpha"]
    per = tasks.class_metrics(tasks.confusion(O.outcomes(spark, sf), keys, "true_class", "predicted_class"), keys)
    df = tasks.classification_report(per, keys)
    return df.select(
        *keys,
        "n",
        R(F.col("accuracy")).alias("micro_accuracy"),
        R(F.col("balanced_accuracy")).alias("macro_accuracy"),
        R(F.col("macro_f1")).alias("macro_f1"),
    )


@query(
    "macro_accuracy",
    f"WITH {SQL_FIXED}, c AS (SELECT seed, true_class, avg(CASE WHEN true_rank = 1 THEN 1.0 ELSE 0.0 END) AS t1, avg(CASE WHEN true_rank <= 5 THEN 1.0 ELSE 0.0 END) AS t5, count(*) AS n, count_if(true_rank = 1) AS k1 FROM oc GROUP BY ALL)"
    + " SELECT seed::BIGINT AS seed, round(avg(t1), 6) AS macro_top1, round(avg(t5), 6) AS macro_top5, round(sum(k1) / sum(n), 6) AS micro_top1 FROM c GROUP BY seed",
)
def macro_accuracy(spark, sf):
    """Mean of class means next to the plain mean."""
    c = O.outcomes(spark, sf).groupBy("seed", "true_class").agg(
        F.avg(F.col("top1").cast("double")).alias("t1"),
        F.avg(F.col("topk").cast("double")).alias("t5"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("top1").alias("k1"),
    )
    return c.groupBy(F.col("seed").cast("long").alias("seed")).agg(
        R(F.avg("t1")).alias("macro_top1"),
        R(F.avg("t5")).alias("macro_top5"),
        R(F.sum("k1") / F.sum("n")).alias("micro_top1"),
    )


_BOTH = O.sql_scores(True)
for _a, _b in (("cs", "cs2"), ("rk", "rk2"), ("oc", "oc2"), ("ac", "ac2"), ("am", "am2"), ("yh", "yh2")):
    _BOTH = _BOTH.replace(f"\n{_a} AS", f"\n{_b} AS").replace(f"FROM {_a} ", f"FROM {_b} ").replace(f"FROM {_a})", f"FROM {_b})").replace(f"JOIN {_a} ", f"JOIN {_b} ")
SQL_BOTH = f"{SQL_FIXED}, {_BOTH}"


@query(
    "paired_outcomes",
    f"WITH {SQL_BOTH}, j AS (SELECT perturbation_id, alpha, a.true_rank = 1 AS l, b.true_rank = 1 AS r FROM oc a JOIN oc2 b USING (seed, signal_id, perturbation_id, alpha))"
    + " SELECT perturbation_id, alpha, count_if(l AND r)::BIGINT AS n_both, count_if(l AND NOT r)::BIGINT AS n_left_only, count_if(NOT l AND r)::BIGINT AS n_right_only, count_if(NOT l AND NOT r)::BIGINT AS n_neither FROM j GROUP BY ALL",
)
def paired_outcomes(spark, sf):
    a = O.outcomes(spark, sf).select(*OUT, F.col("top1").alias("l"))
    b = O.outcomes(spark, sf, True).select(*OUT, F.col("top1").alias("r"))
    left, right = F.col("l"), F.col("r")
    return a.join(b, OUT).groupBy("perturbation_id", "alpha").agg(
        F.count_if(left & right).alias("n_both"),
        F.count_if(left & ~right).alias("n_left_only"),
        F.count_if(~left & right).alias("n_right_only"),
        F.count_if(~left & ~right).alias("n_neither"),
    )


@query(
    "class_harm",
    f"WITH {SQL_FIXED} SELECT cluster_id, perturbation_id, alpha, y + 0.0 AS y FROM yh",
)
def class_harm(spark, sf):
    return O.class_harm(O.outcomes(spark, sf)).withColumn("y", F.col("y") + 0.0)


@query(
    "alpha0_equivalence",
    f"WITH {SQL_BOTH} SELECT a.seed::BIGINT AS seed, count(*)::BIGINT AS n, count_if(a.predicted_class = b.predicted_class AND a.true_rank = b.true_rank)::BIGINT AS n_match FROM oc a JOIN oc2 b USING (seed, signal_id, perturbation_id, alpha) WHERE alpha = 0 GROUP BY ALL",
)
def alpha0_equivalence(spark, sf):
    """Adapted at strength zero must repeat the fixed predictions."""
    keys, fields = ["seed", "signal_id"], ["predicted_class", "true_rank"]
    a = O.outcomes(spark, sf).filter("alpha = 0")
    b = O.outcomes(spark, sf, True).filter("alpha = 0")
    r = U.reproduce(a, b, keys, fields)
    return r.groupBy(F.col("seed").cast("long").alias("seed")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "match").alias("n_match")
    )


@query(
    "baseline_join",
    f"WITH {SQL_FIXED} SELECT c.seed::BIGINT AS seed, c.true_class, c.perturbation_id, c.alpha, round(b.accuracy - c.accuracy, 6) + 0.0 AS harm FROM ac c JOIN ac b ON b.seed = c.seed AND b.true_class = c.true_class AND b.alpha = 0 WHERE c.alpha > 0",
)
def baseline_join(spark, sf):
    acc = O.class_accuracy(O.outcomes(spark, sf))
    df = tasks.against_baseline(acc, ["seed", "true_class"], "accuracy", True)
    return df.select(
        F.col("seed").cast("long").alias("seed"), "true_class", "perturbation_id", "alpha", R(F.col("harm")).alias("harm")
    )


@query(
    "harm_parts",
    f"WITH {SQL_FIXED} SELECT perturbation_id, alpha, round(avg(y), 6) + 0.0 AS signed_mean, round(avg(greatest(y, 0)), 6) + 0.0 AS positive_mean, round(avg(greatest(-y, 0)), 6) + 0.0 AS negative_mean, round(avg(abs(y)), 6) + 0.0 AS absolute_mean,"
    + " CASE WHEN avg(abs(y)) > 0 THEN round(avg(greatest(y, 0)) / avg(abs(y)), 6) END AS positive_share, CASE WHEN avg(abs(y)) > 0 THEN round(avg(greatest(-y, 0)) / avg(abs(y)), 6) END AS negative_share,"
    + " CASE WHEN avg(abs(y)) > 0 THEN 'complete' ELSE 'undefined' END AS denominator_state FROM yh GROUP BY ROLLUP (perturbation_id, alpha) HAVING perturbation_id IS NOT NULL",
)
def harm_parts(spark, sf):
    """Per condition, and per family over all strengths (alpha null)."""
    y = O.class_harm(O.outcomes(spark, sf))
    by_alpha = tasks.harm_parts(y, ["perturbation_id", "alpha"])
    whole = tasks.harm_parts(y, ["perturbation_id"]).withColumn("alpha", F.lit(None).cast("double"))
    df = by_alpha.unionByName(whole)
    nums = [c for c in df.columns if c.endswith("mean") or c.endswith("share")]
    return df.withColumns({c: R(F.col(c)) for c in nums})


# -- measures to harms ----------------------------------------------------------


@query(
    "orient_harm",
    f"WITH {T.perturbed(T.FAMILIES)}, {O.sql_metrics(True)} SELECT metric, perturbation_id, alpha, round(avg(h), 6) + 0.0 AS mean_harm, count_if(h < -1e-9)::BIGINT AS n_improved FROM ml GROUP BY ALL",
)
def orient_harm(spark, sf):
    """Harm of every output against the clean value, lower and higher ones alike; 1e-9 is beyond rounding."""
    long = M.measure_vector(perturb(M.self_values(signals(spark, sf), O.ALL_OUTPUTS), T.FAMILIES, identity=False), O.ALL_OUTPUTS)
    h = M.oriented(F.col("output_id"), F.col("base")[F.col("output_id")], F.col("value"))
    return (
        long.withColumn("h", h)
        .groupBy(F.col("output_id").alias("metric"), "perturbation_id", "alpha")
        .agg(R(F.avg("h")).alias("mean_harm"), F.count_if(F.col("h") < -1e-9).alias("n_improved"))
    )


_VECTOR_SQL = f"""{O.sql_metrics(True)},
mv AS (SELECT signal_id, class_id, perturbation_id, alpha, {', '.join(o for o in O.ALL_OUTPUTS if o != 'structure_to_noise')}, sv.v AS structure_to_noise FROM mh JOIN sv USING (signal_id, class_id, perturbation_id, alpha)),
mw AS (SELECT * FROM mv UNPIVOT INCLUDE NULLS (value FOR output_id IN ({', '.join(O.ALL_OUTPUTS)})))"""


@query(
    "measure_vector",
    f"WITH {T.perturbed(T.FAMILIES)}, {_VECTOR_SQL} SELECT output_id, class_id, perturbation_id, alpha, CASE WHEN value IS NULL THEN 'not_evaluable' ELSE 'complete' END AS state, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean_value FROM mw GROUP BY ALL",
)
def measure_vector(spark, sf):
    """All outputs of every pair, by class and condition."""
    long = M.measure_vector(perturb(signals(spark, sf), T.FAMILIES, identity=False), O.ALL_OUTPUTS)
    return long.groupBy("output_id", "class_id", "perturbation_id", "alpha", "state").agg(
        F.count(F.lit(1)).alias("n"), R(F.avg("value")).alias("mean_value")
    )


@query(
    "cluster_harm",
    f"WITH {T.perturbed(T.FAMILIES)}, {_VECTOR_SQL}, gs AS (SELECT DISTINCT signal_id, group_id FROM sig)"
    + """ SELECT output_id, group_id AS cluster_id, perturbation_id, alpha, CASE WHEN count(value) = count(*) THEN round(sum(value * (1 + signal_id % 3)) / sum(1 + signal_id % 3), 6) + 0.0 END AS harm,
 sum(1 + signal_id % 3)::BIGINT AS total_weight, count(*)::BIGINT AS n, count(value) = count(*) AS complete FROM mw JOIN gs USING (signal_id) GROUP BY ALL""",
)
def cluster_harm(spark, sf):
    """Weighted mean of every output per group and condition with its completeness."""
    df = signals(spark, sf).withColumn("weight", (1 + F.col("signal_id") % 3).cast("long"))
    long = M.measure_vector(perturb(df, T.FAMILIES, identity=False), O.ALL_OUTPUTS)
    out = M.cluster_harm(long.withColumn("harm", F.col("value")), "group_id", ["output_id", "perturbation_id", "alpha"], "weight")
    return out.select(
        "output_id", F.col("group_id").alias("cluster_id"), "perturbation_id", "alpha", R(F.col("harm")).alias("harm"), "total_weight", "n", "complete"
    )


@query(
    "attach_downstream",
    f"WITH {O.SQL_OBS}, h AS (SELECT * FROM xh WHERE NOT (metric = 'sam' AND alpha = 0.8 AND cluster_id = 1))"
    + " SELECT metric, count(*)::BIGINT AS n_joined, (SELECT count(*) FROM yh)::BIGINT - count(*)::BIGINT AS n_holes, round(sum(x * y), 6) + 0.0 AS cross_sum FROM h JOIN yh USING (cluster_id, perturbation_id, alpha) GROUP BY metric",
)
def attach_downstream(spark, sf):
    """Metric harm onto task harm; one hole is cut to exercise the check."""
    obs = O.observations(spark, sf)
    x = obs.select("metric", "cluster_id", "perturbation_id", "alpha", "x").filter(
        ~((F.col("metric") == "sam") & (F.col("alpha") == 0.8) & (F.col("cluster_id") == 1))
    )
    return U.attach_downstream(x, obs.select("metric", "cluster_id", "perturbation_id", "alpha", "y")).select(
        "metric", "n_joined", "n_holes", R(F.col("cross_sum")).alias("cross_sum")
    )


@query(
    "response_curves",
    f"WITH {T.perturbed(T.NONAXIS)}, m AS (SELECT signal_id, perturbation_id, alpha, avg((y - ry) * (y - ry)) AS v FROM pert GROUP BY ALL)"
    + """ SELECT perturbation_id, alpha, round(avg(v), 6) + 0.0 AS mean, round(min(v), 6) + 0.0 AS min, round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.5), 6) + 0.0 AS median,
 round(quantile_cont(v, 0.75), 6) + 0.0 AS q75, round(max(v), 6) + 0.0 AS max, count_if(v <> 0)::BIGINT AS n_nonzero FROM m GROUP BY ALL""",
)
def response_curves(spark, sf):
    keys = ["perturbation_id", "alpha"]
    df = perturb(signals(spark, sf), T.NONAXIS, identity=False)
    df = A.pin(df, {"v": MEASURES["mse"].expression(pair())}).select(*keys, "v")
    q = exact_quantiles(df, keys, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    s = df.groupBy(*keys).agg(
        F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(F.col("v") != 0).alias("n_nonzero")
    )
    out = s.join(q, keys)
    return out.select(*keys, *[R(F.col(c)).alias(c) for c in ("mean", "min", "q25", "median", "q75", "max")], "n_nonzero")


@query(
    "metric_states",
    f"WITH {O.SQL_OBS}, p AS (SELECT unnest({[*O.OUTPUTS, 'snr_peak']!r}) AS metric),"
    + " o AS (SELECT * FROM obs WHERE NOT (metric = 'nmse' AND cluster_id = 0 AND alpha = 0.1))"
    + " SELECT p.metric, 400::BIGINT AS n_planned, count(o.x)::BIGINT AS n_complete, CASE WHEN count(o.x) = 400 THEN 'complete' ELSE 'not_evaluable' END AS state FROM p LEFT JOIN o USING (metric) GROUP BY p.metric",
)
def metric_states(spark, sf):
    """Seven planned outputs, one never run and one with holes."""
    obs = O.observations(spark, sf)
    kept = obs.filter(~((F.col("metric") == "nmse") & (F.col("cluster_id") == 0) & (F.col("alpha") == 0.1)))
    return U.metric_states(kept, obs.select("cluster_id", "perturbation_id", "alpha").distinct(), (*O.OUTPUTS, "snr_peak"))


# -- contrasts between panels ----------------------------------------------------
SQL_PANELS = (
    f"{O.SQL_TASK}, {O.SQL_METRICS}, {O.sql_scores()}, {_BOTH}, "
    + """panels AS MATERIALIZED (SELECT 'fixed' AS panel, metric, cluster_id, perturbation_id, alpha, x, y FROM xh JOIN yh USING (cluster_id, perturbation_id, alpha)
 UNION ALL SELECT 'adapted', metric, cluster_id, perturbation_id, alpha, x, y FROM xh JOIN yh2 USING (cluster_id, perturbation_id, alpha)),"""
    + O.sql_nodes("panels", "panel, metric")
    + ","
    + O.sql_gap("panel, metric")
    + ","
    + O.sql_pairs("panels", "panel, metric")
    + """, st2 AS MATERIALIZED (SELECT panel, metric, ag, oc FROM ag JOIN ocs USING (panel, metric))"""
)


def panels(spark, sf):
    a = O.observations(spark, sf).withColumn("panel", F.lit("fixed"))
    b = O.observations(spark, sf, adapted=True).withColumn("panel", F.lit("adapted"))
    return a.unionByName(b)


def panel_statistics(spark, sf):
    key = (spark.sparkContext.applicationId, sf, "panels")
    if key not in O._CACHE:
        O._CACHE[key] = statistics(panels(spark, sf), ["panel", "metric"]).persist()
    return O._CACHE[key]


@query(
    "paired_obs",
    f"WITH {SQL_PANELS} SELECT a.metric, count(*)::BIGINT AS n_paired, 0::BIGINT AS n_left_only, 0::BIGINT AS n_right_only, count_if(a.x = b.x)::BIGINT AS n_equal_x, count_if(a.y = b.y)::BIGINT AS n_equal_y"
    + " FROM panels a JOIN panels b ON a.panel = 'fixed' AND b.panel = 'adapted' AND a.metric = b.metric AND a.cluster_id = b.cluster_id AND a.perturbation_id = b.perturbation_id AND a.alpha = b.alpha GROUP BY a.metric",
)
def paired_obs(spark, sf):
    return U.paired_observations(O.observations(spark, sf), O.observations(spark, sf, adapted=True), ["metric"])


@query(
    "protocol_gap",
    f"WITH {SQL_BOTH}, g AS (SELECT a.cluster_id, a.perturbation_id, a.alpha, a.y - b.y AS gap FROM yh a JOIN yh2 b USING (cluster_id, perturbation_id, alpha))"
    + " SELECT perturbation_id, alpha, round(avg(gap), 6) + 0.0 AS gap FROM g GROUP BY ROLLUP (perturbation_id, alpha) HAVING perturbation_id IS NOT NULL",
)
def protocol_gap(spark, sf):
    """Task-harm gap fixed minus adapted per condition and averaged over strength."""
    a = O.class_harm(O.outcomes(spark, sf))
    b = O.class_harm(O.outcomes(spark, sf, True)).withColumnRenamed("y", "yb")
    g = a.join(b, ["cluster_id", "perturbation_id", "alpha"]).withColumn("gap", F.col("y") - F.col("yb"))
    df = g.rollup("perturbation_id", "alpha").agg(R(F.avg("gap")).alias("gap"))
    return df.filter(F.col("perturbation_id").isNotNull())


@query(
    "rank_stability",
    f"""WITH {SQL_PANELS}, w AS (SELECT a.metric, round(a.ag, 9) AS a, round(b.ag, 9) AS b, -round(a.oc, 9) AS c, -round(b.oc, 9) AS d FROM st2 a JOIN st2 b ON a.metric = b.metric AND a.panel = 'fixed' AND b.panel = 'adapted'),
v AS (SELECT 'ag' AS statistic, metric, a AS l, b AS r FROM w UNION ALL SELECT 'oc', metric, c, d FROM w),
k AS (SELECT *, (SELECT count(*) FROM v u WHERE u.statistic = v.statistic AND u.l < v.l) + ((SELECT count(*) FROM v u WHERE u.statistic = v.statistic AND u.l = v.l) + 1) / 2.0 AS rl,
  (SELECT count(*) FROM v u WHERE u.statistic = v.statistic AND u.r < v.r) + ((SELECT count(*) FROM v u WHERE u.statistic = v.statistic AND u.r = v.r) + 1) / 2.0 AS rr FROM v),
p AS (SELECT a.statistic, sum(sign(a.l - b.l) * sign(a.r - b.r)) AS num, sum(abs(sign(a.l - b.l))) AS na, sum(abs(sign(a.r - b.r))) AS nb FROM v a JOIN v b USING (statistic) GROUP BY ALL),
t AS (SELECT statistic, (count(*) - count(DISTINCT l))::BIGINT AS left_ties, (count(*) - count(DISTINCT r))::BIGINT AS right_ties, max(abs(rl - rr))::DOUBLE AS max_displacement FROM k GROUP BY ALL)
SELECT statistic, round(num / sqrt(na * nb), 6) + 0.0 AS tau_b, left_ties, right_ties, max_displacement, num / sqrt(na * nb) > 0.9 AS stable, 'complete_numeric' AS state FROM p JOIN t USING (statistic)""",
)
def rank_stability(spark, sf):
    """Ranking of the measures under the two protocols."""
    s = panel_statistics(spark, sf)
    at = lambda p, c: F.max(F.when(F.col("panel") == p, F.col(c)))
    w = s.groupBy("metric").agg(
        *[
            F.round(at(p, c), 9).alias(n)
            for n, p, c in (("la", "fixed", "ag"), ("ra", "adapted", "ag"), ("lo", "fixed", "oc"), ("ro", "adapted", "oc"))
        ]
    )
    ag = L.rank_stability(w.withColumn("statistic", F.lit("ag")), ["statistic"], "la", "ra", True)
    oc = L.rank_stability(w.withColumn("statistic", F.lit("oc")), ["statistic"], "lo", "ro", False)
    df = ag.unionByName(oc)
    return df.withColumns(
        {
            "tau_b": R(F.col("tau_b")),
            "left_ties": F.col("left_ties").cast("long"),
            "right_ties": F.col("right_ties").cast("long"),
        }
    )


_PROFILE = (
    "hp AS (SELECT 1 AS panel_family, contrast AS hypothesis, p_value AS p, observed FROM fp),"
    + HOLM_SQL.format(k="panel_family", t="hp")
    + """,
pf AS (SELECT left(hypothesis, length(hypothesis) - 3) AS metric, max(observed) FILTER (right(hypothesis, 2) = 'ag') AS d_ag, max(observed) FILTER (right(hypothesis, 2) = 'oc') AS d_oc,
  max(p) FILTER (right(hypothesis, 2) = 'ag') AS p_ag, max(p) FILTER (right(hypothesis, 2) = 'oc') AS p_oc,
  max(adjusted_p) FILTER (right(hypothesis, 2) = 'ag') AS adjusted_ag, max(adjusted_p) FILTER (right(hypothesis, 2) = 'oc') AS adjusted_oc FROM hr GROUP BY ALL),
pv AS MATERIALIZED (SELECT *, CASE WHEN adjusted_ag < 0.05 AND d_ag > 0 THEN 'favourable' WHEN adjusted_ag < 0.05 AND d_ag < 0 THEN 'adverse' ELSE 'unresolved' END AS ag_verdict,
  CASE WHEN adjusted_oc < 0.05 AND d_oc > 0 THEN 'favourable' WHEN adjusted_oc < 0.05 AND d_oc < 0 THEN 'adverse' ELSE 'unresolved' END AS oc_verdict FROM pf),
pq AS MATERIALIZED (SELECT *, CASE WHEN ag_verdict = 'favourable' AND oc_verdict = 'favourable' THEN 'joint' WHEN ag_verdict = 'favourable' THEN 'ag_only' WHEN oc_verdict = 'favourable' THEN 'oc_only' ELSE 'none' END AS profile FROM pv)"""
)


def profiles(spark, sf, adapted=False):
    wide, how = contrast_columns(spark, sf, adapted)
    p = I.sign_flip(wide, "cluster_id", how, "panel", N_FLIPS).withColumn("panel_family", F.lit(1))
    p = I.holm(p, ["panel_family"], hypothesis="contrast")
    metric = F.expr("left(contrast, length(contrast) - 3)").alias("metric")

    def at(stat, c):
        return F.max(F.when(F.right("contrast", F.lit(2)) == stat, F.col(c)))

    w = p.groupBy(metric).agg(
        at("ag", "observed").alias("d_ag"), at("oc", "observed").alias("d_oc"), at("ag", "p_value").alias("p_ag"), at("oc", "p_value").alias("p_oc"),
        at("ag", "adjusted_p").alias("adjusted_ag"), at("oc", "adjusted_p").alias("adjusted_oc"),
    )
    return L.decision_profile(w)


@query(
    "decision_profile",
    f"WITH {SQL_FLIP}, {_PROFILE} SELECT metric, round(p_ag, 6) AS p_ag, round(p_oc, 6) AS p_oc, round(adjusted_ag, 6) AS adjusted_ag, round(adjusted_oc, 6) AS adjusted_oc, ag_verdict, oc_verdict, profile FROM pq",
)
def decision_profile(spark, sf):
    return profiles(spark, sf).select(
        "metric", R(F.col("p_ag")).alias("p_ag"), R(F.col("p_oc")).alias("p_oc"),
        R(F.col("adjusted_ag")).alias("adjusted_ag"), R(F.col("adjusted_oc")).alias("adjusted_oc"), "ag_verdict", "oc_verdict", "profile"
    )


@query(
    "reproduce_check",
    f"WITH {O.SQL_OBS}, {O.sql_pairs()}, p AS (SELECT metric, CASE WHEN metric = 'sam' THEN oc + 0.25 ELSE oc END AS oc FROM ocs WHERE metric <> 'nmse' UNION ALL SELECT 'retired', 0.5)"
    + """ SELECT coalesce(p.metric, o.metric) AS metric, CASE WHEN p.metric IS NULL THEN 'missing_left' WHEN o.metric IS NULL THEN 'missing_right' WHEN abs(p.oc - o.oc) <= 1e-9 THEN 'match' ELSE 'mismatch' END AS state,
 CASE WHEN abs(p.oc - o.oc) > 1e-9 THEN 'oc' ELSE '' END AS mismatches FROM p FULL JOIN ocs o ON p.metric = o.metric""",
)
def reproduce_check(spark, sf):
    """A published table with one wrong, one missing and one retired row."""
    oc = L.concordance(L.concordance_cells(O.observations(spark, sf), K), K).select("metric", "oc")
    retired = oc.filter(F.col("metric") == REF).select(F.lit("retired").alias("metric"), F.lit(0.5).alias("oc"))
    published = (
        oc.filter(F.col("metric") != "nmse")
        .withColumn("oc", F.when(F.col("metric") == "sam", F.col("oc") + 0.25).otherwise(F.col("oc")))
        .unionByName(retired)
    )
    df = U.reproduce(published, oc, ["metric"], ["oc"])
    return df.withColumn("mismatches", F.array_join("mismatches", ","))


# -- regression ------------------------------------------------------------------


@query(
    "regression_report",
    """WITH r AS (SELECT l_returnflag, l_quantity AS t, l_extendedprice / 1500 AS p FROM lineitem)
SELECT l_returnflag, count(*)::BIGINT AS n, round(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round(avg(abs(p - t)), 6) AS mae, round(1 - sum((p - t) * (p - t)) / (var_pop(t) * count(*)), 6) + 0.0 AS r2,
 round(sqrt(avg((p - t) * (p - t))) / (max(t) - min(t)), 6) AS normalized_rmse FROM r GROUP BY ALL""",
)
def regression_report(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_quantity").alias("y_true"), (F.col("l_extendedprice") / 1500).alias("y_pred")
    )
    df = tasks.regression_report(li, ["l_returnflag"])
    return df.select("l_returnflag", "n", *[R(F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "normalized_rmse")])


@query(
    "well_harm",
    """WITH e AS (SELECT l_suppkey, l_discount AS alpha, avg(power((l_extendedprice / 1500 - l_quantity) / 49.0, 2)) AS loss FROM lineitem GROUP BY ALL)
SELECT c.l_suppkey, c.alpha, round(c.loss, 6) AS loss, round(c.loss - b.loss, 6) + 0.0 AS harm FROM e c JOIN e b ON b.l_suppkey = c.l_suppkey AND b.alpha = 0 WHERE c.alpha > 0""",
)
def well_harm(spark, sf):
    """Range-normalised squared error per supplier and discount, minus its zero-discount row."""
    e = (F.col("l_extendedprice") / 1500 - F.col("l_quantity")) / 49.0
    loss = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_discount").alias("alpha")).agg(F.avg(e * e).alias("loss"))
    df = tasks.against_baseline(loss, ["l_suppkey"], "loss", False)
    return df.select("l_suppkey", "alpha", R(F.col("loss")).alias("loss"), R(F.col("harm")).alias("harm"))
