"""One call from signals and a task-harm table to contrasts with inference."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import align, infer
from .measure import measure_vector, oriented, self_values, settled
from .perturb import perturb


def metric_harm(signals: DataFrame, measures, perturbations, cluster: str = "class_id", **options) -> DataFrame:
    """Mean oriented harm per (metric, cluster, perturbation, alpha)."""
    cells = perturb(self_values(signals, measures, "_base"), perturbations, identity=False, **options)
    long = measure_vector(cells, measures)
    harm = oriented(F.col("output_id"), F.col("_base")[F.col("output_id")], F.col("value"))
    return long.groupBy(
        F.col("output_id").alias("metric"), F.col(cluster).alias("cluster_id"), "perturbation_id", "alpha"
    ).agg(F.avg(harm).alias("x"), (F.count(harm) == F.count(F.lit(1))).alias("complete")).transform(settled, ["metric"])


def evaluate(
    signals: DataFrame,
    task_harm: DataFrame,
    measures,
    reference: str,
    perturbations,
    cluster: str = "class_id",
    endpoint: str = "panel",
    resamples: int = infer.RESAMPLES,
    flips: int = infer.FLIPS,
    alpha: float = 0.05,
    **options,
) -> DataFrame:
    """AG, OC, contrasts with the reference, bootstrap intervals and Holm-adjusted p.

    ``task_harm``: cluster_id, perturbation_id, alpha, y.  Outputs that are not
    complete on the grid keep their slot in the Holm family but are not tested.
    """
    measures = list(measures)
    if reference not in measures:
        raise ValueError("the reference must be among the measures")
    x = metric_harm(signals, measures, perturbations, cluster, **options)
    bad = x.filter(~F.col("complete")).select("metric").distinct()
    obs = (
        x.join(task_harm, ["cluster_id", "perturbation_id", "alpha"])
        .join(bad, "metric", "left_anti")
        .select("metric", "cluster_id", "perturbation_id", "alpha", "x", "y")
        .persist()
    )
    complete = {r[0] for r in obs.select("metric").distinct().collect()}
    if reference not in complete:
        raise ValueError("the reference output is incomplete")
    keys = ["metric"]
    nodes = align.fitted_nodes(obs, keys).persist()
    cells = align.concordance_cells(obs, keys)
    cluster_oc = align.cluster_concordance(cells, keys).select("metric", "cluster_id", "oc").persist()
    stats = align.alignment_gap(nodes, keys).select("metric", "ag", "state").join(
        cluster_oc.groupBy("metric").agg(F.avg("oc").alias("oc")), "metric"
    )
    point = align.compare(stats, [], reference)
    draws = infer.draw_table(obs, "cluster_id", endpoint, resamples)
    ci = infer.bootstrap_alignment(obs, cluster_oc, reference, draws)

    others = [m for m in measures if m != reference and m in complete]
    ag = align.gap_contributions(nodes, keys)
    both = ag.join(cluster_oc, ["metric", "cluster_id"])

    def at(metric, column):
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    wide = both.groupBy("cluster_id").agg(
        *[(at(reference, "ag_contribution") - at(m, "ag_contribution")).alias(f"{m}|ag") for m in others],
        *[(at(m, "oc") - at(reference, "oc")).alias(f"{m}|oc") for m in others],
    )
    how = {**{f"{m}|ag": "sum" for m in others}, **{f"{m}|oc": "mean" for m in others}}
    renamed = {c: c.replace("|", "__") for c in how}
    wide = wide.withColumnsRenamed(renamed).persist()
    p = infer.sign_flip(wide, "cluster_id", {renamed[c]: h for c, h in how.items()}, endpoint, flips)
    tested = p.select(
        F.lit(1).alias("family"), F.col("contrast").alias("hypothesis"), "p_value", F.col("observed").alias("contrast")
    )
    slots = [f"{m}__{s}" for m in measures if m != reference for s in ("ag", "oc")]
    planned = signals.sparkSession.range(1).select(F.lit(1).alias("family"), F.explode(F.array(*[F.lit(s) for s in slots])).alias("hypothesis"))
    holm = infer.holm_family(planned, tested, ["family"], alpha)
    side = F.substring_index("hypothesis", "__", -1)
    metric = F.expr("left(hypothesis, length(hypothesis) - 4)")
    per = holm.groupBy(metric.alias("metric")).agg(
        *[F.max(F.when(side == s, F.col(c))).alias(f"{n}_{s}") for s in ("ag", "oc") for c, n in (("p_value", "p"), ("adjusted_p", "adjusted_p"), ("rejected", "rejected"))]
    )
    return point.join(ci, "metric").join(per, "metric", "full_outer")
