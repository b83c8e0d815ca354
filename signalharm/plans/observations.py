"""The observation table of the embedding signals: metric harm next to task harm."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.measures import MEASURES
from ..operators import blocks as B
from ..operators import measure as M
from ..operators import signals as S
from ..operators import splits, tasks
from ..operators.perturb import perturb
from . import sqltext as T
from .q_splits import _EMB, SEEDS, SQL_QUERY_LIBRARY
from .tables import signals

ALL_OUTPUTS = tuple(MEASURES)[:13]  # the study's outputs; measures that a user adds come after them
#: Outputs of the queries that start from the observation table: their closed-form SQL covers these.
OUTPUTS = ("mse", "nmse", "sam", "pearson", "wasserstein_1", "structure_to_noise")
GRID = (5.0, 1.0, 56)  # common grid 5..60, inside every perturbed axis
DIGITS = 9  # accuracies are shares: a difference of them is settled at nine decimals


def grid_hits(df: DataFrame) -> DataFrame:
    """Positions of the common grid on the native axis, once per signal; null
    unless every target is a node."""
    hits = A.lets(
        {"x": F.col("axis"), "t": S.grid(*GRID)},
        lambda s: A.let(
            F.transform(s["t"], lambda t: A.last_at_or_below(s["x"], t)),
            lambda p: F.when(
                F.transform(p, lambda j: F.get(s["x"], j - 1)) == s["t"], p
            ),
        ),
    )
    return A.pin(df, {"hits": hits})


def on_grid(df: DataFrame) -> DataFrame:
    """Unit-length signal on the common grid; an unmoved axis that hits every
    target keeps its native values."""
    same = F.col("hits").isNotNull()
    if "ref_axis" in df.columns:
        same = same & ~F.col("perturbation_id").isin("p11", "p12")
    r = F.when(same, F.transform("hits", lambda j: F.get("y", j - 1))).otherwise(
        S.resample_linear(F.col("axis"), F.col("y"), S.grid(*GRID))
    )
    return A.pin(df, {"v": A.l2_normalize(r)})


def split(spark, sf) -> DataFrame:
    g = signals(spark, sf).select("class_id", "group_id")
    return splits.query_library(g, "class_id", "group_id", SEEDS)


def identification(spark: SparkSession, sf: str, adapted: bool = False, families=T.FAMILIES) -> DataFrame:
    """Top-1/top-5 outcome of every query under every condition and seed.

    Fixed: the library stays clean.  Adapted: it comes from the same condition.
    """
    roles = split(spark, sf)
    every = signals(spark, sf)
    asked = roles.filter(F.col("role") == "query")
    fine = B.sound(GRID)
    odd = not every.filter(~fine).isEmpty()
    # only query groups are ever perturbed as queries
    wanted = every.join(asked.select("class_id", "group_id"), ["class_id", "group_id"], "left_semi")
    moved = B.grid_vectors(wanted, families, GRID, (lambda d: by_expressions(d, families)) if odd else None)
    q = moved.join(asked, ["class_id", "group_id"]).withColumnRenamed("class_id", "true_class")
    # the seeds of whose library a group is a member
    member = F.sort_array(F.collect_set(F.when(F.col("role") == "library", F.col("seed")))).alias("seeds")
    members = every.join(roles.groupBy("class_id", "group_id").agg(member).filter(F.size("seeds") > 0), ["class_id", "group_id"])
    lib, rest = members.filter(fine), members.filter(~fine)
    if adapted:
        lib = B.with_state(lib, families)
    ready = by_expressions(rest, families if adapted else ()) if odd else None
    sizes = every.count(), every.join(asked, ["class_id", "group_id"]).count() * (1 + len(families) * 8)
    scores = B.moved_library_scores(q, lib, ready, families, GRID, adapted, sizes, tasks.SCORE_DIGITS)
    whole = ["seed", "signal_id", "perturbation_id", "alpha"]
    return tasks.topk(tasks.rank_classes(scores, whole), whole)


def by_expressions(df: DataFrame, families) -> DataFrame:
    """Unit vectors of every cell on the grid; a vector with nulls or nans is no candidate and has no outcome."""
    out = on_grid(perturb(grid_hits(df), families))
    return out.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


def sql_settled(value: str, keys: str) -> str:
    top = f"max(abs({value})) OVER (PARTITION BY {keys})"
    parts = f"pow(10.0::DOUBLE, 9 - floor(log10({top})))"
    return f"(CASE WHEN {top} > 0 THEN round({value} * {parts}) / {parts} ELSE {value} END)"


def class_accuracy(outcomes: DataFrame) -> DataFrame:
    """Accuracy per (seed, class, condition)."""
    return outcomes.groupBy("seed", "true_class", "perturbation_id", "alpha").agg(
        F.avg(F.col("top1").cast("double")).alias("accuracy")
    )


def class_harm(outcomes: DataFrame) -> DataFrame:
    """Mean over seeds of class accuracy, alpha 0 minus current."""
    acc = (
        class_accuracy(outcomes)
        .groupBy(F.col("true_class").alias("cluster_id"), "perturbation_id", "alpha")
        .agg(F.avg("accuracy").alias("accuracy"))
    )
    base = acc.filter(F.col("perturbation_id") == "id").select(
        "cluster_id", F.col("accuracy").alias("_base")
    )
    return (
        acc.filter(F.col("perturbation_id") != "id")
        .join(base, "cluster_id")
        .select(
            "cluster_id",
            "perturbation_id",
            "alpha",
            F.round(F.col("_base") - F.col("accuracy"), DIGITS).alias("y"),
        )
    )


def metric_harm(spark, sf, outputs=ALL_OUTPUTS, families=T.FAMILIES) -> DataFrame:
    """Mean oriented harm per (class, condition, output) over every signal; ``families`` are the study's."""
    own = signals(spark, sf)
    if B.covers(outputs, families):
        return B.mean_values(own, "class_id", outputs, families).transform(M.settled, ["metric"])
    keys = ["metric", "cluster_id", "perturbation_id", "alpha"]
    long = B.expressed(own, "class_id", outputs, families)
    return long.groupBy(*keys).agg(F.avg("h").alias("x")).transform(M.settled, ["metric"])


_CACHE: dict[tuple, DataFrame] = {}


def outcomes(spark: SparkSession, sf: str, adapted: bool = False) -> DataFrame:
    """Persisted :func:`identification` outcomes."""
    key = (spark.sparkContext.applicationId, sf, "outcomes", adapted)
    if key not in _CACHE:
        _CACHE[key] = identification(spark, sf, adapted).persist()
    return _CACHE[key]


def harms(spark: SparkSession, sf: str, outputs=OUTPUTS) -> DataFrame:
    """Persisted :func:`metric_harm`: the same under both protocols."""
    key = (spark.sparkContext.applicationId, sf, "harms", tuple(outputs))
    if key not in _CACHE:
        _CACHE[key] = metric_harm(spark, sf, outputs).persist()
    return _CACHE[key]


def observations(spark: SparkSession, sf: str, outputs=OUTPUTS, adapted: bool = False) -> DataFrame:
    """``metric, cluster_id, perturbation_id, alpha, x, y``; persisted, because every
    statistic starts from this small table."""
    key = (spark.sparkContext.applicationId, sf, tuple(outputs), adapted)
    if key not in _CACHE:
        x = harms(spark, sf, outputs)
        y = class_harm(outcomes(spark, sf, adapted))
        _CACHE[key] = x.join(y, ["cluster_id", "perturbation_id", "alpha"]).select(
            "metric", "cluster_id", "perturbation_id", "alpha", "x", "y"
        ).persist()
    return _CACHE[key]


# -- DuckDB statement of the same table ---------------------------------------
_CELL = "signal_id, class_id, perturbation_id, alpha"
_W = T.sql_width("x", _CELL)
_WR = T.sql_width("rx", _CELL)
_THRESHOLD = "0.05 * (s.ymax - s.ymin)"
_SQL_PEAKS = f"""{T.sql_peaks("pert", _CELL, _THRESHOLD, "pkc")},
{T.sql_peaks("sig", "signal_id", _THRESHOLD, "pk0")},
pkr AS (SELECT c.perturbation_id, c.alpha, pk0.* FROM pk0, cond c),
{T.sql_match("pkr", "pkc", "signal_id, perturbation_id, alpha", "2.0", "pkm")},
pkn AS (SELECT {_CELL}, (SELECT count(*) FROM pk0 WHERE pk0.signal_id = s.signal_id) AS n_ref, coalesce(c.n, 0) AS n_cand, coalesce(m.n, 0)::DOUBLE AS tp
  FROM (SELECT {_CELL} FROM ms) s LEFT JOIN (SELECT {_CELL}, count(*) AS n FROM pkc GROUP BY ALL) c USING ({_CELL})
  LEFT JOIN (SELECT signal_id, perturbation_id, alpha, count(*) AS n FROM pkm GROUP BY ALL) m USING (signal_id, perturbation_id, alpha)),
pks AS (SELECT {_CELL}, CASE WHEN n_cand = 0 THEN 1.0::DOUBLE ELSE tp / n_cand END AS peak_precision, CASE WHEN n_ref = 0 THEN 1.0::DOUBLE ELSE tp / n_ref END AS peak_recall,
  CASE WHEN n_ref + n_cand = 0 THEN 1.0::DOUBLE ELSE 2 * tp / (n_ref + n_cand) END AS peak_f1, CASE WHEN n_cand = 0 THEN 0.0::DOUBLE ELSE (n_cand - tp) / n_cand END AS artifact_ratio,
  CASE WHEN n_ref = 0 THEN 0.0::DOUBLE ELSE (n_ref - tp) / n_ref END AS missing_ratio FROM pkn),
"""
_MORE_HARMS = """
  {'metric': 'rmse', 'h': rmse}, {'metric': 'mae', 'h': mae}, {'metric': 'artifact_ratio', 'h': artifact_ratio}, {'metric': 'missing_ratio', 'h': missing_ratio},
  {'metric': 'peak_precision', 'h': 1 - peak_precision}, {'metric': 'peak_recall', 'h': 1 - peak_recall}, {'metric': 'peak_f1', 'h': 1 - peak_f1},"""


def sql_metrics(whole: bool = False) -> str:
    """Harms of OUTPUTS, or of ALL_OUTPUTS, as CTEs ``ml`` (signals) and ``xh`` (clusters)."""
    peaks, join, more = (_SQL_PEAKS, f" JOIN pks USING ({_CELL})", _MORE_HARMS) if whole else ("", "", "")
    return f"""
un AS (SELECT *, sqrt(sum(y * y) OVER p) AS ny, sqrt(sum(ry * ry) OVER p) AS nr FROM pert WINDOW p AS (PARTITION BY {_CELL})),
ms AS (SELECT {_CELL}, avg((y - ry) * (y - ry)) AS mse, sqrt(avg((y - ry) * (y - ry))) AS rmse, avg(abs(y - ry)) AS mae, sum((y - ry) * (y - ry)) / sum(ry * ry) AS nmse,
  2 * asin(least(1.0, sqrt(sum((y / ny - ry / nr) * (y / ny - ry / nr))) / 2)) AS sam,
  greatest(-1.0, least(1.0, corr(y, ry))) AS pearson FROM un GROUP BY ALL),
wg AS (SELECT *, {_W} * greatest(y, 0) AS mc, {_WR} * greatest(ry, 0) AS mr FROM pert),
wh AS (SELECT *, sum(mc) OVER p AS tc, sum(mr) OVER p AS tr FROM wg WINDOW p AS (PARTITION BY {_CELL})),
we AS (SELECT {_CELL}, x, mc / tc AS m FROM wh UNION ALL SELECT {_CELL}, rx, -mr / tr FROM wh),
wf AS (SELECT {_CELL}, x, sum(m) AS m FROM we GROUP BY ALL),
wr AS (SELECT *, sum(m) OVER (PARTITION BY {_CELL} ORDER BY x) AS cdf,
      lead(x) OVER (PARTITION BY {_CELL} ORDER BY x) - x AS dx FROM wf),
w1 AS (SELECT {_CELL}, sum(abs(cdf) * dx) AS wasserstein_1 FROM wr GROUP BY ALL),
sn AS (SELECT signal_id, class_id, perturbation_id, alpha, i, y FROM pert
  UNION ALL SELECT signal_id, class_id, 'id', 0.0, i, y FROM sig),
sd AS (SELECT {_CELL}, y, lead(y) OVER (PARTITION BY {_CELL} ORDER BY i) - y AS d FROM sn),
ss AS (SELECT {_CELL}, stddev_pop(y) AS s, quantile_cont(d, 0.5) AS md FROM sd GROUP BY ALL),
sv AS (SELECT {_CELL}, any_value(ss.s) / (quantile_cont(abs(sd.d - ss.md), 0.5) / (0.6744897501960817 * sqrt(2))) AS v
  FROM sd JOIN ss USING ({_CELL}) GROUP BY ALL),
stn AS (SELECT a.signal_id, a.class_id, a.perturbation_id, a.alpha, b.v - a.v AS stn_harm FROM sv a
  JOIN sv b ON b.signal_id = a.signal_id AND b.perturbation_id = 'id' WHERE a.perturbation_id <> 'id'),
{peaks}mh AS (SELECT * FROM ms JOIN w1 USING ({_CELL}) JOIN stn USING ({_CELL}){join}),
ml AS (SELECT {_CELL}, metric, h FROM mh, LATERAL (SELECT unnest([
  {{'metric': 'mse', 'h': mse}}, {{'metric': 'nmse', 'h': nmse}}, {{'metric': 'sam', 'h': sam}},{more}
  {{'metric': 'pearson', 'h': 1 - pearson}}, {{'metric': 'wasserstein_1', 'h': wasserstein_1}},
  {{'metric': 'structure_to_noise', 'h': stn_harm}}], recursive := true))),
xr AS (SELECT metric, class_id AS cluster_id, perturbation_id, alpha, avg(h) AS x FROM ml GROUP BY ALL),
xh AS MATERIALIZED (SELECT metric, cluster_id, perturbation_id, alpha, {sql_settled('x', 'metric')} AS x FROM xr)"""


SQL_METRICS = sql_metrics()

SQL_VECTORS = f"""
gt AS (SELECT k::BIGINT AS k, (5 + k)::DOUBLE AS t FROM range(0, 56) r(k)),
al AS (SELECT signal_id, class_id, group_id, perturbation_id, alpha, i, x, y FROM pert
  UNION ALL SELECT signal_id, class_id, group_id, 'id', 0.0, i, x, y FROM sig),
sg1 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM al WINDOW w AS (PARTITION BY signal_id, perturbation_id, alpha ORDER BY x)),
gv AS (SELECT s.signal_id, s.class_id, s.group_id, s.perturbation_id, s.alpha, g.k,
  s.y + (g.t - s.x) / (s.x1 - s.x) * (s.y1 - s.y) AS v FROM sg1 s JOIN gt g ON g.t >= s.x AND g.t < s.x1),
vv AS MATERIALIZED (SELECT signal_id, class_id, group_id, perturbation_id, alpha, list(v ORDER BY k) AS v, sqrt(sum(v * v)) AS nv FROM gv GROUP BY ALL)"""


def sql_scores(adapted: bool = False) -> str:
    same = " AND l.perturbation_id = q.perturbation_id AND l.alpha = q.alpha" if adapted else ""
    clean = "" if adapted else " AND l.perturbation_id = 'id'"
    return f"""
cs AS MATERIALIZED (SELECT rq.seed, q.signal_id, q.class_id AS true_class, q.perturbation_id, q.alpha, l.class_id,
    max(round(greatest(-1.0, least(1.0, list_dot_product(q.v, l.v) / (q.nv * l.nv))), 12)) AS score
  FROM vv q JOIN ql rq ON rq.class_id = q.class_id AND rq.group_id = q.group_id AND rq.role = 'query'
  JOIN ql rl ON rl.seed = rq.seed AND rl.role = 'library'
  JOIN vv l ON l.class_id = rl.class_id AND l.group_id = rl.group_id{clean}{same}
  GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY seed, signal_id, perturbation_id, alpha ORDER BY score DESC, class_id) AS rank FROM cs),
oc AS MATERIALIZED (SELECT seed, signal_id, true_class, perturbation_id, alpha,
  max(class_id) FILTER (rank = 1) AS predicted_class, max(rank) FILTER (class_id = true_class) AS true_rank FROM rk GROUP BY ALL),
ac AS (SELECT seed, true_class, perturbation_id, alpha, avg(CASE WHEN true_rank = 1 THEN 1.0 ELSE 0.0 END) AS accuracy FROM oc GROUP BY ALL),
am AS (SELECT true_class AS cluster_id, perturbation_id, alpha, avg(accuracy) AS accuracy FROM ac GROUP BY ALL),
yh AS MATERIALIZED (SELECT a.cluster_id, a.perturbation_id, a.alpha, round(b.accuracy - a.accuracy, {DIGITS}) AS y FROM am a
  JOIN am b ON b.cluster_id = a.cluster_id AND b.perturbation_id = 'id' WHERE a.perturbation_id <> 'id')"""


SQL_TASK = ",".join([T.perturbed(T.FAMILIES), _EMB, SQL_QUERY_LIBRARY, SQL_VECTORS])


def sql_observations(adapted: bool = False, whole: bool = False) -> str:
    return (
        SQL_TASK
        + ","
        + sql_metrics(whole)
        + ","
        + sql_scores(adapted)
        + """,
obs AS MATERIALIZED (SELECT metric, cluster_id, perturbation_id, alpha, x, y FROM xh JOIN yh USING (cluster_id, perturbation_id, alpha))"""
    )


SQL_OBS = sql_observations()


def sql_isotonic(source: str, keys: str, name: str = "iso", weight: str = "1.0") -> str:
    """Closed form max over j<=i of min over k>=i of mean(j..k), per key, on
    distinct x: CTE ``name`` with keys, x, fit, sw, swy, swyy."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_p AS MATERIALIZED (SELECT {keys}, x, sum({weight}) AS sw, sum({weight} * y) AS swy, sum({weight} * y * y) AS swyy,
  row_number() OVER (PARTITION BY {keys} ORDER BY x) AS r FROM {source} WHERE {weight} > 0 GROUP BY {keys}, x),
{name}_c AS MATERIALIZED (SELECT *, sum(sw) OVER w AS cw, sum(swy) OVER w AS cy FROM {name}_p WINDOW w AS (PARTITION BY {keys} ORDER BY r)),
{name}_m AS (SELECT {ak}, a.r AS j, b.r AS k, (b.cy - a.cy + a.swy) / (b.cw - a.cw + a.sw) AS m
  FROM {name}_c a JOIN {name}_c b ON {on} AND b.r >= a.r),
{name}_n AS (SELECT {keys}, j, k, min(m) OVER (PARTITION BY {keys}, j ORDER BY k DESC) AS m FROM {name}_m),
{name}_f AS (SELECT {keys}, k AS r, max(m) AS fit FROM {name}_n GROUP BY {keys}, k),
{name} AS MATERIALIZED (SELECT * FROM {name}_c JOIN {name}_f USING ({keys}, r))"""


def sql_nodes(obs: str = "obs", keys: str = "metric") -> str:
    """Both curves at every observation with their squared residuals: CTE ``nodes``."""
    ks = [k.strip() for k in keys.split(",")]
    on_a = " AND ".join(f"a.{k} = o.{k}" for k in ks)
    on_b = " AND ".join(f"b.{k} = o.{k}" for k in ks)
    return f"""
both_ AS (SELECT *, '*' AS part FROM {obs} UNION ALL SELECT *, perturbation_id FROM {obs}),
{sql_isotonic("both_", keys + ", part", "iso")},
nodes AS MATERIALIZED (SELECT o.*, a.fit AS fit_pooled, b.fit AS fit_separate, (o.y - a.fit) * (o.y - a.fit) AS e_pooled, (o.y - b.fit) * (o.y - b.fit) AS e_separate
  FROM {obs} o JOIN iso a ON {on_a} AND a.part = '*' AND a.x = o.x
  JOIN iso b ON {on_b} AND b.part = o.perturbation_id AND b.x = o.x)"""


def sql_pairs(obs: str = "obs", keys: str = "metric") -> str:
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
pr AS (SELECT {ak}, a.cluster_id, a.perturbation_id AS left_family, b.perturbation_id AS right_family, a.x - b.x AS dx, a.y - b.y AS dy
  FROM {obs} a JOIN {obs} b ON {on} AND a.cluster_id = b.cluster_id AND a.perturbation_id < b.perturbation_id),
cells AS MATERIALIZED (SELECT {keys}, cluster_id, left_family, right_family, count_if(dx <> 0 AND dy <> 0 AND (dx > 0) = (dy > 0))::BIGINT AS agree,
  count_if(dx <> 0 AND dy <> 0 AND (dx > 0) <> (dy > 0))::BIGINT AS disagree, count_if(dx = 0 AND dy <> 0)::BIGINT AS metric_tie,
  count_if(dx <> 0 AND dy = 0)::BIGINT AS downstream_tie, count_if(dx = 0 AND dy = 0)::BIGINT AS double_tie, count(*)::BIGINT AS n_pairs FROM pr GROUP BY ALL),
coc AS MATERIALIZED (SELECT {keys}, cluster_id, sum(agree)::BIGINT AS agree, sum(disagree)::BIGINT AS disagree, sum(metric_tie)::BIGINT AS metric_tie,
  sum(downstream_tie)::BIGINT AS downstream_tie, sum(double_tie)::BIGINT AS double_tie, sum(n_pairs)::BIGINT AS n_pairs,
  (sum(agree) + 0.5 * (sum(metric_tie) + sum(downstream_tie) + sum(double_tie))) / sum(n_pairs) AS oc FROM cells GROUP BY ALL),
ocs AS MATERIALIZED (SELECT {keys}, sum(agree)::BIGINT AS agree, sum(disagree)::BIGINT AS disagree, sum(metric_tie)::BIGINT AS metric_tie,
  sum(downstream_tie)::BIGINT AS downstream_tie, sum(double_tie)::BIGINT AS double_tie, sum(n_pairs)::BIGINT AS n_pairs, avg(oc) AS oc FROM coc GROUP BY ALL)"""


def sql_gap(keys: str = "metric") -> str:
    return f"""
ag0 AS (SELECT {keys}, count(*)::BIGINT AS n_observations, var_pop(y) * count(*) AS sst, sum(e_pooled) AS sse_pooled,
  sum(e_separate) AS sse_separate, min(x) = max(x) AS cm FROM nodes GROUP BY {keys}),
ag AS MATERIALIZED (SELECT * EXCLUDE (cm), CASE WHEN NOT sst > 0 THEN NULL WHEN cm THEN 0.0 WHEN sse_pooled < sse_separate AND (sse_pooled - sse_separate) / sst >= -1e-12
   THEN 0.0 ELSE (sse_pooled - sse_separate) / sst END AS ag,
  CASE WHEN sst > 0 THEN 1 - sse_pooled / sst END AS r2_pooled, CASE WHEN sst > 0 THEN 1 - sse_separate / sst END AS r2_separate,
  CASE WHEN NOT sst > 0 THEN 'constant_downstream' WHEN cm THEN 'constant_metric' ELSE 'complete' END AS state FROM ag0)"""
