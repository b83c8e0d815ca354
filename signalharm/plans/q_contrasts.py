"""Contrasts between panels and representations with intervals from shared draws."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.measures import MEASURES, Pair
from ..operators import align as L
from ..operators import blocks as B
from ..operators import contrasts as C
from ..operators import infer as I
from ..operators import measure as M
from ..operators import signals as S
from . import observations as O
from . import sqltext as T
from .q_align import R9, scoped, statistics
from .q_infer import DRAWS, REF, sql_draw_statistics, sql_draws, sql_flip
from .q_models import _GM, grid_pairs
from .q_tasks import _PROFILE, SQL_BOTH, SQL_PANELS, panel_statistics, panels, profiles
from .registry import query
from .tables import signals

R = A.rounded
W1 = "wasserstein_1"
FIXED, ADAPTED = "fixed", "adapted"


def _cached(spark, sf, name, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in O._CACHE:
        O._CACHE[key] = make().persist()
    return O._CACHE[key]


def _drawn(spark, sf, obs, keys):
    """Statistics of every draw; all panels share the endpoint's draw table."""
    oc = L.cluster_concordance(L.concordance_cells(obs, keys), keys).select(*keys, "cluster_id", "oc")
    return I.draw_statistics(obs, oc, I.draw_table(O.observations(spark, sf), "cluster_id", "panel", DRAWS), keys)


def panel_draws(spark, sf):
    return _cached(spark, sf, "panel-draws", lambda: _drawn(spark, sf, panels(spark, sf), ["panel", "metric"]))


def _rounded(df, by):
    return df.select(*by, *[(R9 if "oc" in c else R)(F.col(c)).alias(c) for c in df.columns if c not in by])


def _sql_bounds(*names):
    digits = {n: 9 if "oc" in n else 6 for n in names}
    return ", ".join(
        f"CASE WHEN count({n}) = count(*) THEN round(quantile_cont({n}, {q}), {digits[n]}) + 0.0 END AS {n}_{side}"
        for n in names
        for q, side in ((0.025, "lower"), (0.975, "upper"))
    )


def _sql_points(*names, table="p"):
    return ", ".join(f"round({table}.{n}, {9 if 'oc' in n else 6}) + 0.0 AS {n}" for n in names)


# -- protocols -------------------------------------------------------------------

_PROTOCOL = ("delta_ag", "delta_oc", "interaction_ag", "interaction_oc")


def _sql_protocol(stats: str, extra: str = "") -> str:
    on = "".join(f" AND b.{c} = a.{c} AND ra.{c} = a.{c} AND rb.{c} = a.{c}" for c in extra.split(",") if c)
    return f"""SELECT a.metric{''.join(f', a.{c}' for c in extra.split(',') if c)}, b.ag - a.ag AS delta_ag, b.oc - a.oc AS delta_oc,
  (rb.ag - b.ag) - (ra.ag - a.ag) AS interaction_ag, (b.oc - rb.oc) - (a.oc - ra.oc) AS interaction_oc
 FROM {stats} a JOIN {stats} b ON b.metric = a.metric JOIN {stats} ra ON ra.metric = '{REF}' AND ra.panel = '{FIXED}' JOIN {stats} rb ON rb.metric = '{REF}' AND rb.panel = '{ADAPTED}'
 WHERE a.panel = '{FIXED}' AND b.panel = '{ADAPTED}'{on}"""


@query(
    "protocol_contrast",
    f"WITH {SQL_PANELS}, {sql_draws('panels', 'cluster_id', 'panel')}, {sql_draw_statistics('panels', 'panel, metric')},"
    + f" p AS ({_sql_protocol('st2')}), d AS ({_sql_protocol('ds', 'resample')}), i AS (SELECT metric, {_sql_bounds(*_PROTOCOL)} FROM d GROUP BY metric)"
    + f" SELECT p.metric, {_sql_points(*_PROTOCOL)}, i.* EXCLUDE (metric) FROM p JOIN i ON i.metric = p.metric",
)
def protocol_contrast(spark, sf):
    """Adapted minus fixed library: AG, OC and the change of the contrast to the reference, with intervals."""
    point, drawn = panel_statistics(spark, sf), panel_draws(spark, sf)

    def with_reference(stats, by):
        ref = stats.filter(F.col("metric") == REF).select(*by, "panel", F.col("ag").alias("rag"), F.col("oc").alias("roc"))
        return stats.join(ref, [*by, "panel"])

    endpoints = {f"{c}_{p}": ({"panel": p}, c) for c in ("ag", "oc", "rag", "roc") for p in (FIXED, ADAPTED)}

    def change(c):
        return F.col(f"{c}_{ADAPTED}") - F.col(f"{c}_{FIXED}")

    contrasts = {
        "delta_ag": change("ag"),
        "delta_oc": change("oc"),
        "interaction_ag": change("rag") - change("ag"),
        "interaction_oc": change("oc") - change("roc"),
    }
    df = C.contrast_intervals(with_reference(point, []), with_reference(drawn, ["resample"]), ["metric"], endpoints, contrasts)
    return _rounded(df, ["metric"])


# -- representations and scopes ----------------------------------------------------

CELL = ["representation", "scope", "panel", "metric"]


def represented(spark, sf):
    """Observations of the reference and the transport measure, native and on the common grid, per panel and scope."""
    t = S.grid(*O.GRID)
    pair = Pair(t, F.col("gr"), t, F.col("gc"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), MEASURES[m].expression(pair).alias("h")) for m in (REF, W1)])

    def expressed(own):
        g = grid_pairs(spark, sf, own)
        return g.select(F.col("class_id").alias("cluster_id"), "perturbation_id", "alpha", F.inline(cells))

    x = B.mean_values(signals(spark, sf), "class_id", (REF, W1), T.FAMILIES, O.GRID, False, expressed).transform(M.settled, ["metric"])
    native = panels(spark, sf).filter(F.col("metric").isin(REF, W1))
    y = native.filter(F.col("metric") == REF).select("panel", "cluster_id", "perturbation_id", "alpha", "y")
    grid = x.join(y, ["cluster_id", "perturbation_id", "alpha"]).select(*native.columns)
    both = native.withColumn("representation", F.lit("native")).unionByName(grid.withColumn("representation", F.lit("common_grid")))
    return scoped(both)


def represented_obs(spark, sf):
    return _cached(spark, sf, "represented", lambda: represented(spark, sf))


def represented_statistics(spark, sf):
    return _cached(spark, sf, "represented-statistics", lambda: statistics(represented_obs(spark, sf), CELL))


def represented_draws(spark, sf):
    return _cached(spark, sf, "represented-draws", lambda: _drawn(spark, sf, represented_obs(spark, sf), CELL))


_K = "representation, scope, panel, metric"
_GC = "signal_id, cluster_id, perturbation_id, alpha"
SQL_REPRESENTED = (
    f"{O.SQL_TASK}, {O.SQL_METRICS}, {SQL_BOTH.removeprefix(O.SQL_TASK + ", ")}, {_GM}, "
    + f"""gw AS (SELECT *, CASE WHEN k IN (0, 55) THEN 0.5 ELSE 1.0 END * greatest(c, 0) AS mc, CASE WHEN k IN (0, 55) THEN 0.5 ELSE 1.0 END * greatest(r, 0) AS mr FROM gp),
gf AS (SELECT *, sum(mc) OVER w / sum(mc) OVER v - sum(mr) OVER w / sum(mr) OVER v AS f FROM gw WINDOW w AS (PARTITION BY {_GC} ORDER BY k), v AS (PARTITION BY {_GC})),
gm AS (SELECT {_GC}, avg((c - r) * (c - r)) AS mse, sum(abs(f)) FILTER (k < 55) AS w1 FROM gf GROUP BY ALL),
xg AS (SELECT 'mse' AS metric, cluster_id, perturbation_id, alpha, avg(mse) AS x FROM gm GROUP BY ALL UNION ALL SELECT '{W1}', cluster_id, perturbation_id, alpha, avg(w1) FROM gm GROUP BY ALL),
gx AS (SELECT metric, cluster_id, perturbation_id, alpha, {O.sql_settled('x', 'metric')} AS x FROM xg),
ys AS (SELECT '{FIXED}' AS panel, * FROM yh UNION ALL SELECT '{ADAPTED}', * FROM yh2),
rx AS (SELECT 'native' AS representation, metric, cluster_id, perturbation_id, alpha, x FROM xh WHERE metric IN ('{REF}', '{W1}') UNION ALL SELECT 'common_grid', metric, cluster_id, perturbation_id, alpha, x FROM gx),
ro AS (SELECT representation, panel, metric, cluster_id, perturbation_id, alpha, x, y FROM rx JOIN ys USING (cluster_id, perturbation_id, alpha)),
so AS MATERIALIZED (SELECT 'all5' AS scope, * FROM ro UNION ALL SELECT 'no_axis', * FROM ro WHERE perturbation_id IN ('p08', 'p09', 'p10')),"""
    + O.sql_nodes("so", _K)
    + ","
    + O.sql_gap(_K)
    + ","
    + O.sql_pairs("so", _K)
    + f", rs AS MATERIALIZED (SELECT {_K}, ag, oc FROM ag JOIN ocs USING ({_K})), {sql_draws('so', 'cluster_id', 'panel')}, {sql_draw_statistics('so', _K)}"
)
_INTERACTION = tuple(f"{n}_{c}" for c in ("ag", "oc") for n in ("delta_a", "delta_b", "interaction"))


def _sql_interaction(stats: str, key: str) -> str:
    def at(panel, metric, c):
        return f"max({c}) FILTER (panel = '{panel}' AND metric = '{metric}')"

    cols = []
    for c, (a, b) in (("ag", (REF, W1)), ("oc", (W1, REF))):
        d = [f"({at(p, a, c)} - {at(p, b, c)})" for p in (FIXED, ADAPTED)]
        cols += [f"{d[0]} AS delta_a_{c}", f"{d[1]} AS delta_b_{c}", f"{d[1]} - {d[0]} AS interaction_{c}"]
    return f"SELECT {key}, {', '.join(cols)} FROM {stats} GROUP BY {key}"


@query(
    "interactions",
    f"WITH {SQL_REPRESENTED}, p AS ({_sql_interaction('rs', 'representation, scope')}), d AS ({_sql_interaction('ds', 'representation, scope, resample')}),"
    + f" i AS (SELECT representation, scope, {_sql_bounds(*_INTERACTION)} FROM d GROUP BY ALL)"
    + f" SELECT p.representation, p.scope, {_sql_points(*_INTERACTION)}, i.* EXCLUDE (representation, scope) FROM p JOIN i USING (representation, scope)",
)
def interactions(spark, sf):
    """Contrast of the transport measure to the reference, adapted minus fixed, per representation and scope."""
    by = ["representation", "scope"]
    endpoints = {
        f"{c}_{p}_{m}": ({"panel": p, "metric": m}, c) for c in ("ag", "oc") for p in (FIXED, ADAPTED) for m in (REF, W1)
    }

    def delta(c, p):
        a, b = (REF, W1) if c == "ag" else (W1, REF)
        return F.col(f"{c}_{p}_{a}") - F.col(f"{c}_{p}_{b}")

    contrasts = {}
    for c in ("ag", "oc"):
        a, b = delta(c, FIXED), delta(c, ADAPTED)
        contrasts |= {f"delta_a_{c}": a, f"delta_b_{c}": b, f"interaction_{c}": b - a}
    df = C.contrast_intervals(represented_statistics(spark, sf), represented_draws(spark, sf), by, endpoints, contrasts)
    return _rounded(df, by)


_BRIDGE = ("native_w1_ag", "common_grid_mse_ag", "delta_ag", "native_w1_oc", "common_grid_mse_oc", "delta_oc")


def _sql_bridge(stats: str, key: str) -> str:
    w = "FILTER (representation = 'native' AND metric = 'wasserstein_1')"
    g = "FILTER (representation = 'common_grid' AND metric = 'mse')"
    return f"""SELECT {key}, max(ag) {w} AS native_w1_ag, max(ag) {g} AS common_grid_mse_ag, max(ag) {g} - max(ag) {w} AS delta_ag,
 max(oc) {w} AS native_w1_oc, max(oc) {g} AS common_grid_mse_oc, max(oc) {w} - max(oc) {g} AS delta_oc FROM {stats} GROUP BY {key}"""


@query(
    "bridges",
    f"WITH {SQL_REPRESENTED}, p AS ({_sql_bridge('rs', 'panel, scope')}), d AS ({_sql_bridge('ds', 'panel, scope, resample')}),"
    + f" i AS (SELECT panel, scope, {_sql_bounds('delta_ag', 'delta_oc')} FROM d GROUP BY ALL)"
    + f" SELECT p.panel, p.scope, {_sql_points(*_BRIDGE)}, i.* EXCLUDE (panel, scope) FROM p JOIN i USING (panel, scope)",
)
def bridges(spark, sf):
    """Native transport measure against the squared error on the common grid, per panel and scope."""
    by = ["panel", "scope"]
    native, grid = {"representation": "native", "metric": W1}, {"representation": "common_grid", "metric": REF}
    endpoints = {f"{n}_{c}": (cell, c) for c in ("ag", "oc") for n, cell in (("native_w1", native), ("common_grid_mse", grid))}
    contrasts = {n: F.col(n) for n in endpoints} | {
        "delta_ag": F.col("common_grid_mse_ag") - F.col("native_w1_ag"),
        "delta_oc": F.col("native_w1_oc") - F.col("common_grid_mse_oc"),
    }
    df = C.contrast_intervals(represented_statistics(spark, sf), represented_draws(spark, sf), by, endpoints, contrasts)
    return _rounded(df, by).select(*by, *_BRIDGE, "delta_ag_lower", "delta_ag_upper", "delta_oc_lower", "delta_oc_upper")


# -- panels ------------------------------------------------------------------------


def _sql_summary(panel: str) -> str:
    return (
        f"SELECT * FROM (WITH {sql_flip(panel == ADAPTED)}, {_PROFILE}, {O.sql_gap()}, {sql_draws('obs', 'cluster_id', 'panel')}, "
        + f"ro AS (SELECT * FROM obs WHERE metric = '{REF}'), {sql_draw_statistics('ro', 'metric')}, i AS (SELECT {_sql_bounds('ag', 'oc')} FROM ds)"
        + f""" SELECT '{panel}' AS panel, round((SELECT ag FROM ag WHERE metric = '{REF}'), 6) AS reference_ag, round((SELECT oc FROM ocs WHERE metric = '{REF}'), 9) AS reference_oc,
 any_value(ag_lower) AS reference_ag_lower, any_value(ag_upper) AS reference_ag_upper, any_value(oc_lower) AS reference_oc_lower, any_value(oc_upper) AS reference_oc_upper,
 coalesce(string_agg(metric, ';' ORDER BY metric) FILTER (profile = 'joint'), '') AS joint, coalesce(string_agg(metric, ';' ORDER BY metric) FILTER (profile = 'ag_only'), '') AS ag_only,
 coalesce(string_agg(metric, ';' ORDER BY metric) FILTER (profile = 'oc_only'), '') AS oc_only FROM pq, i)"""
    )


@query("panel_summary", " UNION ALL ".join(map(_sql_summary, (FIXED, ADAPTED))))
def panel_summary(spark, sf):
    """Reference statistics with intervals and the three verdict lists of each panel."""
    point = panel_statistics(spark, sf).filter(F.col("metric") == REF)
    drawn = panel_draws(spark, sf).filter(F.col("metric") == REF)
    contrasts = {"reference_ag": F.col("ag"), "reference_oc": F.col("oc")}
    endpoints = {c: ({"metric": REF}, c) for c in ("ag", "oc")}
    ref = _rounded(C.contrast_intervals(point, drawn, ["panel"], endpoints, contrasts), ["panel"])

    def names(profile):
        return F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("profile") == profile, F.col("metric")))), ";"
        ).alias(profile)

    verdicts = [profiles(spark, sf, p == ADAPTED).withColumn("panel", F.lit(p)) for p in (FIXED, ADAPTED)]
    lists = verdicts[0].unionByName(verdicts[1]).groupBy("panel").agg(names("joint"), names("ag_only"), names("oc_only"))
    return ref.join(lists, "panel")


_SHARES = ("positive_share", "absolute_share")


def _share_state(kind: str) -> str:
    return f"CASE WHEN p.{kind}_share IS NULL THEN 'undefined' WHEN i.{kind}_share_lower IS NULL THEN 'bootstrap_undefined' ELSE 'complete' END AS {kind}_state"


@query(
    "harm_shares",
    f"WITH {SQL_BOTH}, ys AS (SELECT '{FIXED}' AS panel, * FROM yh UNION ALL SELECT '{ADAPTED}', * FROM yh2), {sql_draws('ys', 'cluster_id', 'panel')},"
    + """ wd AS (SELECT * FROM draws UNION ALL SELECT DISTINCT -1, cluster_id, 1 FROM ys),
sm AS (SELECT panel, resample, perturbation_id, sum(weight * greatest(y, 0)) / sum(weight) AS pm, sum(weight * abs(y)) / sum(weight) AS am FROM ys JOIN wd USING (cluster_id) GROUP BY ALL),
tt AS (SELECT panel, resample, sum(pm) AS pt, sum(am) AS tot FROM sm GROUP BY ALL),
cm AS (SELECT panel, resample, perturbation_id AS component, pm, am FROM sm UNION ALL SELECT panel, resample, 'axis', sum(pm), sum(am) FROM sm WHERE perturbation_id IN ('p11', 'p12') GROUP BY ALL),
sh AS (SELECT panel, resample, component, CASE WHEN pt > 0 THEN pm / pt END AS positive_share, CASE WHEN tot > 0 THEN am / tot END AS absolute_share FROM cm JOIN tt USING (panel, resample)),
p AS (SELECT * FROM sh WHERE resample = -1),"""
    + f" i AS (SELECT panel, component, {_sql_bounds(*_SHARES)} FROM sh WHERE resample >= 0 GROUP BY ALL)"
    + f" SELECT p.panel, p.component, {_sql_points(*_SHARES)}, i.* EXCLUDE (panel, component), {_share_state('positive')}, {_share_state('absolute')} FROM p JOIN i USING (panel, component)",
)
def harm_shares(spark, sf):
    """Family shares of positive and absolute harm, and of the two axis families together, recomputed in each draw."""
    harms = [O.class_harm(O.outcomes(spark, sf, p == ADAPTED)).withColumn("panel", F.lit(p)) for p in (FIXED, ADAPTED)]
    y = harms[0].unionByName(harms[1])
    draws = I.draw_table(y, "cluster_id", "panel", DRAWS)
    df = C.shares(y, "cluster_id", ["panel"], "perturbation_id", {"axis": ("p11", "p12")}, draws)
    names = [c for c in df.columns if "share" in c]
    return df.select("panel", "component", *[R(F.col(c)).alias(c) for c in names], "positive_state", "absolute_state")
