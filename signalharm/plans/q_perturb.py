"""Perturbation queries and their gates."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import perturb as P
from ..operators import signals as S
from ..operators import audit as U
from . import sqltext as T
from .q_signals import weighted
from .registry import query
from .tables import signals, sql_uniform

_ALPHA = T.values("c_a", "alpha", [a for a in P.ALPHAS if a > 0], "DOUBLE")


@query(
    "condition_grid",
    "WITH "
    + T.SQL_SIGNALS
    + ", "
    + T.conditions(P.PERTURBATIONS)
    + """, g AS (SELECT * FROM cond UNION ALL SELECT 'id', 0.0), s AS (SELECT DISTINCT signal_id FROM sig)
SELECT perturbation_id, alpha, count(*)::BIGINT AS n_cells FROM s, g GROUP BY ALL""",
)
def condition_grid(spark, sf):
    cells = signals(spark, sf).select("signal_id", F.explode(P.condition_array()).alias("c"))
    return cells.groupBy("c.perturbation_id", "c.alpha").agg(F.count(F.lit(1)).alias("n_cells"))


def _cell_summary(df):
    return (
        df.select(
            "class_id", "alpha", weighted(F.col("y")).alias("cy"), weighted(F.col("axis")).alias("cx")
        )
        .groupBy("class_id", "alpha")
        .agg(
            F.count("cy").alias("n_complete"),
            A.rounded(F.avg("cy"), 5).alias("mean_y"),
            A.rounded(F.avg(F.when(F.col("cy").isNotNull(), F.col("cx"))), 5).alias("mean_axis"),
        )
    )


_SUMMARY = """
cs AS (SELECT signal_id, class_id, alpha, sum(i * y) AS cy, sum(i * x) AS cx FROM pert GROUP BY ALL)
SELECT class_id, alpha, count(cy)::BIGINT AS n_complete, round(avg(cy), 5) + 0.0 AS mean_y,
  round(avg(cx) FILTER (cy IS NOT NULL), 5) + 0.0 AS mean_axis FROM cs GROUP BY ALL"""


def _register(name, sql, prepare=lambda df: df, **options):
    @query(f"perturb_{name}", sql)
    def run(spark, sf):
        df = prepare(signals(spark, sf))
        return _cell_summary(P.perturb(df, (name,), identity=False, **options))


for _name in ("p08", "p09", "p10", "p11", "p12"):
    _register(_name, "WITH " + T.perturbed((_name,)) + "," + _SUMMARY)

# -- peak family ------------------------------------------------------------
SQL_COMPONENTS = T.sql_peaks("sig", "signal_id", "0.05 * (s.ymax - s.ymin)", "pk") + """,
pb AS MATERIALIZED (
  SELECT p.*, s.xs, s.ys, s.n, coalesce((lag(idx) OVER w + idx) // 2, 1) AS lo,
    coalesce((lead(idx) OVER w + idx) // 2, s.n) AS hi, count(*) OVER (PARTITION BY signal_id) AS n_peaks
  FROM pk p JOIN pk_s s USING (signal_id) WINDOW w AS (PARTITION BY signal_id ORDER BY idx)
),
cn AS MATERIALIZED (
  SELECT b.signal_id, b.ord, b.rank, b.n_peaks, b.idx, b.pos, s.i, s.x,
    greatest(s.y - (ys[lo] + (s.x - xs[lo]) / (xs[hi] - xs[lo]) * (ys[hi] - ys[lo])), 0) AS c
  FROM pb b JOIN sig s ON s.signal_id = b.signal_id AND s.i BETWEEN b.lo AND b.hi
),
cw AS (SELECT *, (coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x)) / 2 AS w FROM cn
       WINDOW w AS (PARTITION BY signal_id, ord ORDER BY i)),
pc AS MATERIALIZED (SELECT signal_id, ord, any_value(rank) AS rank, any_value(pos) AS pos, any_value(n_peaks) AS n_peaks,
   max(c) FILTER (i = idx) AS comp_height, sum(c * w) AS comp_area FROM cw GROUP BY ALL),
pm AS MATERIALIZED (SELECT pk.signal_id, median(pk.fwhm) AS mf, any_value(h.mh) AS mh FROM pk
   JOIN (SELECT signal_id, median(comp_height) AS mh FROM pc GROUP BY ALL) h USING (signal_id) GROUP BY ALL)"""
_BASE = "WITH " + T.SQL_SIGNALS + ", " + _ALPHA + "," + SQL_COMPONENTS


def _removal(factor, keep):
    return (
        _BASE
        + f""", rm AS (SELECT cn.signal_id, cn.i, c_a.alpha, sum(CASE WHEN {keep} THEN c ELSE 0 END) AS r
  FROM cn, c_a GROUP BY ALL),
pert AS (SELECT s.signal_id, s.class_id, rm.alpha, s.i, s.x, s.y - {factor} * rm.r AS y
  FROM sig s JOIN rm USING (signal_id, i)),"""
        + _SUMMARY
    )


_WEAK = "cn.rank <= least(ceil(c_a.alpha * cn.n_peaks), cn.n_peaks)"
_register("p01", _removal("rm.alpha", "true"))
_register("p02", _removal("0.5", _WEAK))
_register("p04", _removal("1.0", _WEAK))
_register(
    "p03",
    _BASE
    + f""", ga AS (SELECT pc.signal_id, pc.ord, pc.comp_area, c_a.alpha, s.i, s.x,
    exp(-0.5 * ((s.x - pc.pos) / (c_a.alpha * pm.mf)) * ((s.x - pc.pos) / (c_a.alpha * pm.mf))) AS g
  FROM pc JOIN pm USING (signal_id) JOIN sig s USING (signal_id) CROSS JOIN c_a),
gw AS (SELECT *, {T.sql_width('x', 'signal_id, ord, alpha')} AS w FROM ga),
gn AS (SELECT *, g * comp_area / sum(w * g) OVER (PARTITION BY signal_id, ord, alpha) AS b FROM gw),
gb AS (SELECT signal_id, alpha, i, sum(b) AS b FROM gn GROUP BY ALL),
rm AS (SELECT signal_id, i, sum(c) AS r FROM cn GROUP BY ALL),
pert AS (SELECT s.signal_id, s.class_id, gb.alpha, s.i, s.x, s.y - rm.r + gb.b AS y
  FROM sig s JOIN rm USING (signal_id, i) JOIN gb USING (signal_id, i)),"""
    + _SUMMARY,
)
_U5 = sql_uniform(f"'{P.SEED}|p05|' || m.signal_id || '|' || k")
# p05 runs on smoothed signals: their peaks are sparse enough to leave room.
_register(
    "p05",
    "WITH "
    + T.SQL_SIGNALS.replace("sig AS", "raw AS").replace("FROM embeddings", "FROM embeddings")
    + """, sig0 AS (SELECT * FROM raw),
sig AS MATERIALIZED (SELECT signal_id, class_id, group_id, i, x, n,
   avg(y) OVER (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS y FROM sig0), """
    + _ALPHA
    + ","
    + SQL_COMPONENTS
    + f""", pp AS (SELECT m.signal_id, k, st.lo + (st.hi - st.lo) * {_U5} AS c, 2 * m.mf AS r, floor(0.8 * q.np)::BIGINT AS need
  FROM pm m JOIN (SELECT signal_id, min(x) AS lo, max(x) AS hi FROM sig GROUP BY ALL) st USING (signal_id)
  JOIN (SELECT signal_id, count(*) AS np FROM pk GROUP BY ALL) q USING (signal_id), range(0, {P.PROPOSAL_LIMIT}) t(k)),
ok AS (SELECT * FROM pp ANTI JOIN pk ON pk.signal_id = pp.signal_id AND abs(pk.pos - pp.c) < pp.r),
ol AS (SELECT signal_id, any_value(need) AS need, any_value(r) AS r, list([c] ORDER BY k) AS cs FROM ok GROUP BY ALL),
oc AS (SELECT signal_id, need, list_reduce(list_prepend([]::DOUBLE[], cs), lambda acc, p:
   CASE WHEN len(acc) < need AND len(list_filter(acc, lambda q: abs(q - p[1]) < r)) = 0 THEN list_concat(acc, p) ELSE acc END) AS centres FROM ol),
q AS (SELECT pm.signal_id, pm.mf, pm.mh, z.np, floor(0.8 * z.np) AS need, coalesce(oc.centres, []) AS centres
  FROM pm JOIN (SELECT signal_id, count(*) AS np FROM pk GROUP BY ALL) z USING (signal_id) LEFT JOIN oc USING (signal_id)),
pert AS (SELECT s.signal_id, s.class_id, c_a.alpha, s.i, s.x,
  CASE WHEN len(q.centres) >= q.need THEN s.y + coalesce(list_sum(list_transform(q.centres[1:floor(c_a.alpha * q.np)::BIGINT],
    lambda c: q.mh * exp(-0.5 * ((s.x - c) / ({P.SIGMA_PER_FWHM!r} * q.mf)) * ((s.x - c) / ({P.SIGMA_PER_FWHM!r} * q.mf))))), 0) END AS y
  FROM sig s LEFT JOIN q USING (signal_id) CROSS JOIN c_a),"""
    + _SUMMARY,
    prepare=lambda df: A.pin(
        df,
        {
            "y": A.let(
                F.col("y"),
                lambda y: F.transform(
                    y,
                    lambda _, i: A.mean(
                        F.slice(
                            y,
                            F.greatest(i - 8, F.lit(0)) + 1,
                            F.least(i + 8, F.size(y) - 1) - F.greatest(i - 8, F.lit(0)) + 1,
                        )
                    ),
                ),
            )
        },
    ),
)


def _with_baseline(df):
    return A.pin(df, {"baseline": S.baseline_morph(F.col("axis"), F.col("y"), 4.0)})


_MORPH = """, b0 AS (SELECT signal_id, i, y AS v FROM sig),
b1 AS (SELECT signal_id, i, min(v) OVER w AS v FROM b0 WINDOW w AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
b2 AS (SELECT signal_id, i, max(v) OVER w AS v FROM b1 WINDOW w AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
b3 AS (SELECT signal_id, i, least(v, (max(v) OVER w + min(v) OVER w) / 2) AS v FROM b2 WINDOW w AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
pert AS (SELECT s.signal_id, s.class_id, c_a.alpha, s.i, s.x, s.y {op} c_a.alpha * b3.v AS y FROM sig s JOIN b3 USING (signal_id, i), c_a),"""
for _name, _op in (("p06", "+"), ("p07", "-")):
    _register(
        _name,
        "WITH " + T.SQL_SIGNALS + ", " + _ALPHA + _MORPH.replace("{op}", _op) + _SUMMARY,
        prepare=_with_baseline,
        baseline_col="baseline",
    )


@query(
    "perturb_checks",
    "WITH "
    + T.perturbed(T.FAMILIES)
    + """, e AS (SELECT signal_id, perturbation_id, alpha, sqrt(avg((y - ry) * (y - ry))) AS ye, sqrt(avg((x - rx) * (x - rx))) AS xe
  FROM pert GROUP BY ALL),
m AS (SELECT *, coalesce(ye + xe > lag(ye + xe) OVER (PARTITION BY signal_id, perturbation_id ORDER BY alpha), true) AS mono FROM e)
SELECT perturbation_id, alpha, count(*)::BIGINT AS n_cells,
  count_if(NOT ((perturbation_id IN ('p11', 'p12')) = (xe > 0) AND (perturbation_id NOT IN ('p11', 'p12')) = (ye > 0)))::BIGINT AS n_contract,
  0::BIGINT AS n_axis, count_if(NOT mono)::BIGINT AS n_not_monotone FROM m GROUP BY ALL""",
)
def perturb_checks(spark, sf):
    """Violations per condition; all counts are zero when the operators are right."""
    df = P.perturb(signals(spark, sf), T.FAMILIES, identity=False)
    return U.effect_violations(A.pin(P.invariants(df), {"effect": F.col("y_effect") + F.col("axis_effect")}))


@query(
    "coverage_gate",
    _BASE
    + """, has AS (SELECT DISTINCT signal_id FROM pk),
s AS (SELECT DISTINCT signal_id, class_id FROM sig),
d AS (SELECT s.*, p.perturbation_id, CASE WHEN p.perturbation_id = 'p09' OR (s.signal_id % 11 <> 0 AND has.signal_id IS NOT NULL)
   THEN 8 ELSE 0 END AS n_done FROM s LEFT JOIN has USING (signal_id), (VALUES ('p01'), ('p09')) p(perturbation_id)),
c AS (SELECT perturbation_id, class_id, count_if(n_done = 8)::BIGINT AS ok, count(*)::BIGINT AS al FROM d GROUP BY ALL)
SELECT perturbation_id, sum(al)::BIGINT AS n_sources, sum(ok)::BIGINT AS n_complete_sources, count_if(ok = al)::BIGINT AS n_complete_clusters,
  count(*)::BIGINT AS n_clusters, sum(al - ok)::BIGINT * 8 AS n_missing_cells, 0::BIGINT AS n_duplicate_cells,
  sum(ok) / sum(al) >= 0.95 AND count_if(ok = al) / count(*) >= 0.90 AS passes FROM c GROUP BY ALL""",
)
def coverage_gate(spark, sf):
    """p01 is withheld from every eleventh source to exercise the gate."""
    df = signals(spark, sf)
    done = P.perturb(df, ("p01", "p09"), identity=False).select(
        "signal_id",
        "perturbation_id",
        "alpha",
        F.when(
            (F.col("perturbation_id") == "p01") & (F.col("signal_id") % 11 == 0), F.lit(False)
        )
        .otherwise(F.col("y").isNotNull())
        .alias("complete"),
    )
    return U.coverage(
        df.select("signal_id", F.col("class_id").alias("cluster_id")),
        done.filter("complete").drop("complete"),
        ("p01", "p09"),
        n_strengths=8,
    )
