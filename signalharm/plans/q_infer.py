"""Inference queries: bootstrap, sign flips, Holm."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import align as L
from ..operators import infer as I
from . import observations as O
from . import sqltext as T
from .q_align import K, R9, statistics
from .registry import query
from .tables import sql_uniform, table

R = A.rounded
DRAWS = I.RESAMPLES
N_FLIPS = I.FLIPS
REF = "mse"


def sql_draws(clusters: str, cluster: str, endpoint: str, resamples: int = DRAWS) -> str:
    seed = I.endpoint_seed(endpoint, "bootstrap")
    u = sql_uniform(f"'{seed}|' || r.resample || '|' || k.k")
    return f"""
ck AS MATERIALIZED (SELECT {cluster}, row_number() OVER (ORDER BY md5('{seed}|0|' || {cluster}), {cluster}) - 1 AS k, count(*) OVER () AS n
  FROM (SELECT DISTINCT {cluster} FROM {clusters})),
dd AS (SELECT r.resample, floor({u} * k.n)::BIGINT AS k FROM ck k, range(0, {resamples}) r(resample)),
draws AS MATERIALIZED (SELECT dd.resample, ck.{cluster}, count(*)::BIGINT AS weight FROM dd JOIN ck USING (k) GROUP BY ALL)"""


def sql_ci(v: str) -> str:
    return f"round(quantile_cont({v}, 0.025), 6) + 0.0 AS {v}_lower, round(quantile_cont({v}, 0.975), 6) + 0.0 AS {v}_upper"


@query(
    "draw_table",
    f"WITH {T.SQL_SIGNALS}, cl AS (SELECT DISTINCT class_id AS cluster_id FROM sig), {sql_draws('cl', 'cluster_id', 'panel')}"
    + " SELECT resample::BIGINT AS resample, cluster_id, weight FROM draws",
)
def draw_table(spark, sf):
    clusters = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("cluster_id"))
    d = I.draw_table(clusters, "cluster_id", "panel", DRAWS)
    return d.withColumn("resample", F.col("resample").cast("long"))


def sql_sign(endpoint: str, cluster: str) -> str:
    """Sign of ``flip`` for a cluster: one bit of the digest of (seed, flip // 128, cluster)."""
    digest = f"md5('{I.endpoint_seed(endpoint, 'sign_flip')}|' || (flip // 128) || '|' || {cluster})"
    return f"CASE WHEN (('0x' || substr({digest}, 1 + ((flip % 128) // 4)::INT, 1))::INT >> (flip % 4)::INT) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


def sql_explained(source: str, keys: str, name: str) -> str:
    """CTE ``name``: per key the sum over pools of swy^2 / sw of the increasing fit; ``source`` has keys, x, y, weight.

    Points in order of x are folded into a list of pools; a new point takes the
    last pools while they are not below it.
    """
    pool = "{'w': a.w + b.w, 't': a.t + b.t, 'n': a.n + 1, 'go': true}"
    stop = "{'w': a.w, 't': a.t, 'n': a.n, 'go': false}"
    return f"""
{name}_p AS (SELECT {keys}, x, sum(weight)::DOUBLE AS w, sum(weight * y)::DOUBLE AS t FROM {source} GROUP BY {keys}, x),
{name}_l AS (SELECT {keys}, list([{{'w': w, 't': t}}] ORDER BY x) AS pts FROM {name}_p GROUP BY {keys}),
{name} AS MATERIALIZED (SELECT {keys}, list_sum(list_transform(list_reduce(pts, lambda s, p:
  list_transform([list_reduce(list_prepend({{'w': p[1].w, 't': p[1].t, 'n': 0, 'go': true}}, list_transform(list_reverse(s), lambda e: {{'w': e.w, 't': e.t, 'n': 1, 'go': true}})),
    lambda a, b: CASE WHEN a.go AND b.t * a.w >= a.t * b.w THEN {pool} ELSE {stop} END)], lambda z: list_append(s[1:len(s) - z.n], {{'w': z.w, 't': z.t}}))[1]),
  lambda e: e.t * e.t / e.w)) AS explained FROM {name}_l)"""


def sql_draw_statistics(obs: str, keys: str) -> str:
    """CTE ``ds``: keys, resample, ag, oc of every draw, from ``draws``, ``obs`` and ``coc`` (cluster concordance with the keys)."""
    return f"""
wo AS MATERIALIZED (SELECT {keys}, d.resample, o.perturbation_id, o.x, o.y, d.weight FROM {obs} o JOIN draws d USING (cluster_id)),
wb AS (SELECT *, '*' AS part FROM wo UNION ALL SELECT *, perturbation_id FROM wo),
{sql_explained('wb', f'{keys}, resample, part', 'ex')},
bp AS (SELECT {keys}, resample, sum(explained) FILTER (part = '*') AS p, sum(explained) FILTER (part <> '*') AS s FROM ex GROUP BY ALL),
bt AS (SELECT {keys}, resample, sum(weight * y * y) AS yy, sum(weight * y * y) - sum(weight * y) * sum(weight * y) / sum(weight) AS sst, min(x) = max(x) AS still FROM wo GROUP BY ALL),
ba AS (SELECT {keys}, resample, CASE WHEN NOT sst > 1e-13 * yy THEN NULL WHEN still THEN 0.0 ELSE greatest((s - p) / sst, 0) END AS ag FROM bp JOIN bt USING ({keys}, resample)),
bo AS (SELECT {keys}, d.resample, sum(c.oc * d.weight) / sum(d.weight) AS oc FROM coc c JOIN draws d USING (cluster_id) GROUP BY ALL),
ds AS MATERIALIZED (SELECT {keys}, resample, ag, oc FROM ba JOIN bo USING ({keys}, resample))"""


@query(
    "bootstrap_alignment",
    f"WITH {O.SQL_OBS}, {sql_draws('obs', 'cluster_id', 'panel')}, {O.sql_pairs()}, {sql_draw_statistics('obs', 'metric')},"
    + f"""
bb AS (SELECT a.*, r.ag - a.ag AS d_ag, a.oc - r.oc AS d_oc FROM ds a JOIN ds r ON r.resample = a.resample AND r.metric = '{REF}')
SELECT metric, {sql_ci('ag')}, {sql_ci('d_ag')}, round(quantile_cont(oc, 0.025), 9) + 0.0 AS oc_lower, round(quantile_cont(oc, 0.975), 9) + 0.0 AS oc_upper,
  round(quantile_cont(d_oc, 0.025), 9) + 0.0 AS d_oc_lower, round(quantile_cont(d_oc, 0.975), 9) + 0.0 AS d_oc_upper, count_if(ag IS NULL)::BIGINT AS failed_draws FROM bb GROUP BY metric""",
)
def bootstrap_alignment(spark, sf):
    obs = O.observations(spark, sf)
    oc = L.cluster_concordance(L.concordance_cells(obs, K), K).select("metric", "cluster_id", "oc")
    draws = I.draw_table(obs, "cluster_id", "panel", DRAWS)
    df = I.bootstrap_alignment(obs, oc, REF, draws)
    return df.select(
        "metric",
        *[
            (R9 if "oc" in c else R)(F.col(c)).alias(c)
            for c in df.columns
            if c not in ("metric", "failed_draws")
        ],
        "failed_draws",
    )


def supplier_effect(spark, sf):
    """Per supplier: mean price per unit of open minus that of finished lines."""
    li = table(spark, sf, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity") / 1000
    return li.groupBy("l_suppkey", "l_returnflag").agg(
        (
            F.avg(F.when(F.col("l_linestatus") == "O", unit))
            - F.avg(F.when(F.col("l_linestatus") == "F", unit))
        ).alias("effect")
    ).filter(F.col("effect").isNotNull())


@query(
    "bootstrap_mean",
    f"""WITH e AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice / l_quantity / 1000) FILTER (l_linestatus = 'O') - avg(l_extendedprice / l_quantity / 1000) FILTER (l_linestatus = 'F') AS effect
 FROM lineitem GROUP BY ALL HAVING effect IS NOT NULL), {sql_draws('e', 'l_suppkey', 'supplier')},
b AS (SELECT l_returnflag, resample, sum(effect * weight) / sum(weight) AS mean FROM e JOIN draws USING (l_suppkey) GROUP BY ALL),
p AS (SELECT l_returnflag, avg(effect) AS mean FROM e GROUP BY ALL),
c AS (SELECT l_returnflag, {sql_ci('mean')} FROM b GROUP BY ALL)
SELECT l_returnflag, round(mean, 6) + 0.0 AS mean, mean_lower, mean_upper FROM p JOIN c USING (l_returnflag)""",
)
def bootstrap_mean(spark, sf):
    e = supplier_effect(spark, sf)
    draws = I.Draws(e, "l_suppkey", "supplier", DRAWS)
    df = I.bootstrap_mean(e, "l_suppkey", ["l_returnflag"], "effect", draws)
    return df.select("l_returnflag", *[R(F.col(c)).alias(c) for c in ("mean", "mean_lower", "mean_upper")])


_TARGETS = (
    # target, truth, control prediction, candidate prediction, range
    ("quantity", "l_quantity", "25.5", "l_extendedprice / 1500", 49.0),
    ("discount", "100 * l_discount", "5.0", "5.0 + 10 * l_tax - 0.4", 10.0),
    ("tax", "100 * l_tax", "4.0", "4.0 + 10 * l_discount - 0.5", 8.0),
)
_RANGES = [t[4] for t in _TARGETS]
_L, _RR = [f"c{i}" for i in range(3)], [f"s{i}" for i in range(3)]
_WELLS = (
    "w AS MATERIALIZED (SELECT l_suppkey, count(*)::BIGINT AS n, "
    + ", ".join(
        f"sum(({c} - {y}) * ({c} - {y})) AS c{i}, sum(({s} - {y}) * ({s} - {y})) AS s{i}"
        for i, (_, y, c, s, _r) in enumerate(_TARGETS)
    )
    + " FROM lineitem GROUP BY ALL)"
)


def wells(spark, sf):
    """Squared errors of two predictors per supplier and target, and the row count."""
    li = table(spark, sf, "lineitem")
    aggs = []
    for i, (_, y, c, s, _r) in enumerate(_TARGETS):
        for name, e in (("c", c), ("s", s)):
            d = F.expr(f"({e}) - ({y})").cast("double")
            aggs.append(F.sum(d * d).alias(f"{name}{i}"))
    return li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), *aggs)


def _sql_rmse(cols, n="n"):
    return "((" + " + ".join(f"sqrt(({c}) / {n}) / {r}" for c, r in zip(cols, _RANGES)) + ") / 3)"


@query(
    "bootstrap_ratio",
    f"WITH {_WELLS}, {sql_draws('w', 'l_suppkey', 'supplier')},"
    + "s AS (SELECT resample, sum(n * weight) AS n, "
    + ", ".join(f"sum({c} * weight) AS {c}" for c in (*_L, *_RR))
    + f""" FROM w JOIN draws USING (l_suppkey) GROUP BY resample),
e AS (SELECT 100.0 * ({_sql_rmse(_L)} - {_sql_rmse(_RR)}) AS effect FROM s),
t AS (SELECT sum(n) AS n, {', '.join(f'sum({c}) AS {c}' for c in (*_L, *_RR))} FROM w)
SELECT (SELECT round(100.0 * ({_sql_rmse(_L)} - {_sql_rmse(_RR)}), 6) FROM t) AS effect, {sql_ci('effect')} FROM e""",
)
def bootstrap_ratio(spark, sf):
    w = wells(spark, sf)
    draws = I.Draws(w, "l_suppkey", "supplier", DRAWS)
    df = I.bootstrap_rmse_effect(w, "l_suppkey", _L, _RR, _RANGES, draws)
    return df.select(*[R(F.col(c)).alias(c) for c in df.columns])


@query(
    "sign_flip_rmse",
    f"WITH {_WELLS}, h AS (SELECT l_suppkey, "
    + ", ".join(f"(c{i} - s{i}) / 2 AS h{i}" for i in range(3))
    + " FROM w), t AS (SELECT sum(n) AS n, "
    + ", ".join(f"sum((c{i} + s{i}) / 2) AS m{i}, sum((c{i} - s{i}) / 2) AS o{i}" for i in range(3))
    + f""" FROM w),
g AS (SELECT flip, {sql_sign('supplier', 'l_suppkey')} AS s, h.* FROM h, range(0, {N_FLIPS}) r(flip)),
f AS (SELECT flip, {', '.join(f'sum(h{i} * s) AS s{i}' for i in range(3))} FROM g GROUP BY flip),
e AS (SELECT 100.0 * ({_sql_rmse([f'greatest(m{i} + s{i}, 0)' for i in range(3)])} - {_sql_rmse([f'greatest(m{i} - s{i}, 0)' for i in range(3)])}) AS v,
  100.0 * ({_sql_rmse([f'greatest(m{i} + o{i}, 0)' for i in range(3)])} - {_sql_rmse([f'greatest(m{i} - o{i}, 0)' for i in range(3)])}) AS o FROM f, t)
SELECT round(max(o), 6) AS observed, count_if(abs(v) + 1e-15 >= abs(o))::BIGINT AS n_extreme, round((count_if(abs(v) + 1e-15 >= abs(o)) + 1) / {N_FLIPS + 1}.0::DOUBLE, 6) AS p_value FROM e""",
)
def sign_flip_rmse(spark, sf):
    df = I.sign_flip_rmse(wells(spark, sf), "l_suppkey", _L, _RR, _RANGES, "supplier", N_FLIPS)
    return df.select(R(F.col("observed")).alias("observed"), "n_extreme", R(F.col("p_value")).alias("p_value"))


@query(
    "bootstrap_mechanism",
    f"""WITH v AS (SELECT l_suppkey, l_returnflag, l_discount AS alpha, avg(l_tax) FILTER (l_linenumber = 7) AS value FROM lineitem GROUP BY ALL),
{sql_draws('v', 'l_suppkey', 'supplier')},
f AS (SELECT l_returnflag, alpha, avg(value) AS fm, count(value)::BIGINT AS n FROM v GROUP BY ALL),
s AS (SELECT l_returnflag, alpha, resample, sum(value * weight) / sum(weight) AS m FROM v JOIN draws USING (l_suppkey) WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT f.l_returnflag, f.alpha, r.resample, coalesce(s.m, f.fm) AS v FROM f CROSS JOIN (SELECT DISTINCT resample FROM draws) r LEFT JOIN s ON s.l_returnflag = f.l_returnflag AND s.alpha = f.alpha AND s.resample = r.resample),
e AS (SELECT l_returnflag, resample, avg(v) AS estimate FROM c GROUP BY ALL),
i AS (SELECT l_returnflag, {sql_ci('estimate')} FROM e GROUP BY ALL),
p AS (SELECT l_returnflag, round(avg(fm), 6) AS estimate, min(n)::BIGINT AS min_contributing FROM f GROUP BY ALL)
SELECT p.*, i.estimate_lower, i.estimate_upper, 'complete' AS state FROM p JOIN i USING (l_returnflag)""",
)
def bootstrap_mechanism(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.groupBy("l_suppkey", "l_returnflag", F.col("l_discount").alias("alpha")).agg(
        F.avg(F.when(F.col("l_linenumber") == 7, F.col("l_tax"))).alias("value")
    )
    draws = I.Draws(v, "l_suppkey", "supplier", DRAWS)
    df = I.bootstrap_incomplete(v, "l_suppkey", ["l_returnflag"], draws)
    return df.select(
        "l_returnflag",
        *[R(F.col(c)).alias(c) for c in ("estimate", "estimate_lower", "estimate_upper")],
        "min_contributing",
        "state",
    )


def contrast_columns(spark, sf, adapted=False):
    """Wide per-cluster contrasts against the reference, persisted: every test reads it."""
    others = [m for m in O.OUTPUTS if m != REF]
    how = {**{f"{m}_ag": "sum" for m in others}, **{f"{m}_oc": "mean" for m in others}}
    key = (spark.sparkContext.applicationId, sf, "contrasts", adapted)
    if key not in O._CACHE:
        O._CACHE[key] = _contrasts(spark, sf, others, adapted).persist()
    return O._CACHE[key], how


def _contrasts(spark, sf, others, adapted):
    obs = O.observations(spark, sf, adapted=adapted)
    ag = L.gap_contributions(L.fitted_nodes(obs, K), K)
    oc = L.cluster_concordance(L.concordance_cells(obs, K), K)
    both = ag.join(oc.select("metric", "cluster_id", "oc"), ["metric", "cluster_id"])

    def at(metric, col):
        return F.max(F.when(F.col("metric") == metric, F.col(col)))

    return both.groupBy("cluster_id").agg(
        *[(at(REF, "ag_contribution") - at(m, "ag_contribution")).alias(f"{m}_ag") for m in others],
        *[(at(m, "oc") - at(REF, "oc")).alias(f"{m}_oc") for m in others],
    )


def sql_flip(adapted: bool = False) -> str:
    return (
        f"{O.sql_observations(adapted)}, {O.sql_nodes()}, {O.sql_pairs()}, "
        + f"""tt AS (SELECT metric, var_pop(y) * count(*) AS sst FROM nodes GROUP BY metric),
cc AS MATERIALIZED (SELECT metric, cluster_id, sum(e_pooled - e_separate) / any_value(sst) AS a FROM nodes JOIN tt USING (metric) GROUP BY ALL),
df AS MATERIALIZED (SELECT c.metric || '_ag' AS contrast, c.cluster_id, r.a - c.a AS v, 'sum' AS how FROM cc c JOIN cc r ON r.cluster_id = c.cluster_id AND r.metric = '{REF}' WHERE c.metric <> '{REF}'
  UNION ALL SELECT c.metric || '_oc', c.cluster_id, c.oc - r.oc, 'mean' FROM coc c JOIN coc r ON r.cluster_id = c.cluster_id AND r.metric = '{REF}' WHERE c.metric <> '{REF}'),
ob AS (SELECT contrast, CASE any_value(how) WHEN 'sum' THEN sum(v) ELSE avg(v) END AS observed FROM df GROUP BY contrast),
sg AS (SELECT flip, cluster_id, {sql_sign('panel', 'cluster_id')} AS s
  FROM (SELECT DISTINCT cluster_id FROM df), range(0, {N_FLIPS}) r(flip)),
pe AS (SELECT contrast, flip, CASE any_value(how) WHEN 'sum' THEN sum(s * v) ELSE avg(s * v) END AS t FROM df JOIN sg USING (cluster_id) GROUP BY ALL),
fp AS MATERIALIZED (SELECT contrast, any_value(observed) AS observed, count_if(abs(t) + 1e-15 >= abs(observed))::BIGINT AS n_extreme,
  (count_if(abs(t) + 1e-15 >= abs(observed)) + 1) / {N_FLIPS + 1}.0::DOUBLE AS p_value FROM pe JOIN ob USING (contrast) GROUP BY contrast)"""
    )


SQL_FLIP = sql_flip()


@query(
    "sign_flip",
    f"WITH {SQL_FLIP} SELECT contrast, round(observed, 6) + 0.0 AS observed, n_extreme, round(p_value, 6) + 0.0 AS p_value FROM fp",
)
def sign_flip(spark, sf):
    wide, how = contrast_columns(spark, sf)
    df = I.sign_flip(wide, "cluster_id", how, "panel", N_FLIPS)
    return df.select("contrast", R(F.col("observed")).alias("observed"), "n_extreme", R(F.col("p_value")).alias("p_value"))


HOLM_SQL = """
ho AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY p, hypothesis) AS holm_rank, count(*) OVER (PARTITION BY {k}) AS family_size FROM {t}),
hr AS (SELECT *, max(least(1.0, (family_size - holm_rank + 1) * p)) OVER (PARTITION BY {k} ORDER BY p, hypothesis) AS adjusted_p FROM ho)"""


@query(
    "holm",
    f"WITH {SQL_FLIP}, hp AS (SELECT right(contrast, 2) AS statistic, contrast AS hypothesis, p_value AS p FROM fp),"
    + HOLM_SQL.format(k="statistic", t="hp")
    + " SELECT statistic, hypothesis, round(p, 6) AS p_value, round(adjusted_p, 6) AS adjusted_p, holm_rank::BIGINT AS holm_rank, family_size::BIGINT AS family_size, adjusted_p < 0.05 AS rejected FROM hr",
)
def holm(spark, sf):
    wide, how = contrast_columns(spark, sf)
    p = I.sign_flip(wide, "cluster_id", how, "panel", N_FLIPS).select(
        F.right("contrast", F.lit(2)).alias("statistic"), F.col("contrast").alias("hypothesis"), "p_value"
    )
    df = I.holm(p, ["statistic"])
    return df.select(
        "statistic",
        "hypothesis",
        R(F.col("p_value")).alias("p_value"),
        R(F.col("adjusted_p")).alias("adjusted_p"),
        F.col("holm_rank").cast("long").alias("holm_rank"),
        F.col("family_size").cast("long").alias("family_size"),
        "rejected",
    )


_PLANNED = [f"{m}_{s}" for m in (*O.OUTPUTS, "snr_peak") if m != REF for s in ("ag", "oc")]


@query(
    "holm_family",
    f"WITH {SQL_FLIP}, pl AS (SELECT unnest({_PLANNED!r}) AS hypothesis), hp AS (SELECT 1 AS one, hypothesis, p_value, observed, coalesce(p_value, 1.0) AS p FROM pl LEFT JOIN fp ON contrast = hypothesis),"
    + HOLM_SQL.format(k="one", t="hp")
    + """ SELECT hypothesis, CASE WHEN p_value IS NULL THEN 'not_tested' ELSE 'tested' END AS state, round(p_value, 6) AS p_value, family_size::BIGINT AS family_size,
 CASE WHEN p_value IS NOT NULL THEN round(adjusted_p, 6) END AS adjusted_p, coalesce(adjusted_p < 0.05 AND p_value IS NOT NULL AND observed > 0, false) AS rejected FROM hr""",
)
def holm_family(spark, sf):
    """Planned slots include one measure that was not run."""
    wide, how = contrast_columns(spark, sf)
    tested = I.sign_flip(wide, "cluster_id", how, "panel", N_FLIPS).select(
        F.lit(1).alias("one"), F.col("contrast").alias("hypothesis"), "p_value", F.col("observed").alias("contrast")
    )
    planned = (
        wide.agg(F.count(F.lit(1)))
        .select(F.lit(1).alias("one"), F.explode(F.array(*[F.lit(h) for h in _PLANNED])).alias("hypothesis"))
    )
    df = I.holm_family(planned, tested, ["one"])
    return df.select(
        "hypothesis",
        "state",
        R(F.col("p_value")).alias("p_value"),
        F.col("family_size").cast("long").alias("family_size"),
        R(F.col("adjusted_p")).alias("adjusted_p"),
        "rejected",
    )


def seed_accuracy(spark, sf):
    """Per seed: top-1 accuracy over all conditions, fixed and adapted library."""

    def acc(adapted, name):
        return O.outcomes(spark, sf, adapted).groupBy("seed").agg(
            F.avg(F.col("top1").cast("double")).alias(name)
        )

    return acc(False, "fixed").join(acc(True, "adapted"), "seed").withColumn(
        "difference", F.col("adapted") - F.col("fixed")
    )


SQL_SEEDS = f"""{O.SQL_TASK}, {O.sql_scores()},
{O.sql_scores(True).replace('cs AS', 'cs2 AS').replace('FROM cs)', 'FROM cs2)').replace('rk AS', 'rk2 AS').replace('FROM rk ', 'FROM rk2 ').replace('oc AS', 'oc2 AS').replace('FROM oc ', 'FROM oc2 ').replace('ac AS', 'ac2 AS').replace('FROM ac ', 'FROM ac2 ').replace('am AS', 'am2 AS').replace('FROM am a', 'FROM am2 a').replace('JOIN am b', 'JOIN am2 b').replace('yh AS', 'yh2 AS')},
sa AS MATERIALIZED (SELECT seed, fixed, adapted, adapted - fixed AS difference FROM
 (SELECT seed, avg(CASE WHEN true_rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS fixed FROM oc GROUP BY seed) JOIN
 (SELECT seed, avg(CASE WHEN true_rank = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS adapted FROM oc2 GROUP BY seed) USING (seed))"""


@query(
    "bootstrap_seeds",
    f"WITH {SQL_SEEDS}, {sql_draws('sa', 'seed', 'seeds')}, b AS (SELECT resample, sum(fixed * weight) / 5 AS fixed, sum(adapted * weight) / 5 AS adapted, sum(difference * weight) / 5 AS difference FROM sa JOIN draws USING (seed) GROUP BY resample)"
    + f""" SELECT round((SELECT avg(fixed) FROM sa), 6) AS fixed, round((SELECT avg(adapted) FROM sa), 6) AS adapted, round((SELECT avg(difference) FROM sa), 6) + 0.0 AS difference,
 {sql_ci('fixed')}, {sql_ci('adapted')}, {sql_ci('difference')} FROM b""",
)
def bootstrap_seeds(spark, sf):
    v = seed_accuracy(spark, sf)
    cols = ["fixed", "adapted", "difference"]
    draws = I.draw_table(v, "seed", "seeds", DRAWS)
    s = I.bootstrap_sums(v, "seed", [], cols, draws)
    ci = I.interval(s.select(*[(F.col(c) / F.col("_w")).alias(c) for c in cols]), [], cols)
    point = v.agg(*[F.avg(c).alias(c) for c in cols])
    df = point.join(ci, F.lit(True))
    return df.select(*[R(F.col(c)).alias(c) for c in df.columns])


_EXACT = """
pt AS (SELECT b, sum(difference * CASE WHEN (b >> (seed - 1)) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) / 5 AS m FROM sa, range(0, 32) t(b) GROUP BY b),
xo AS (SELECT avg(difference) AS observed FROM sa),
xf AS (SELECT any_value(observed) AS observed, count(*)::BIGINT AS n_patterns, count_if(abs(m) + 1e-15 >= abs(observed))::BIGINT AS n_extreme FROM pt, xo)"""


@query(
    "sign_flip_exact",
    f"WITH {SQL_SEEDS}, {_EXACT} SELECT round(observed, 6) + 0.0 AS observed, n_patterns, n_extreme, n_extreme / n_patterns AS p_value FROM xf",
)
def sign_flip_exact(spark, sf):
    v = seed_accuracy(spark, sf).withColumn("_all", F.lit(1))
    df = I.sign_flip_exact(v, ["_all"], "seed", "difference").drop("_all")
    return df.withColumn("observed", R(F.col("observed")))


@query(
    "seed_aggregate",
    f"WITH {SQL_SEEDS}, {_EXACT}, {sql_draws('sa', 'seed', 'seeds')}, b AS (SELECT resample, sum(difference * weight) / 5 AS difference FROM sa JOIN draws USING (seed) GROUP BY resample), ci AS (SELECT {sql_ci('difference')} FROM b)"
    + """ SELECT sa.seed::BIGINT AS seed, round(fixed, 6) AS fixed, round(adapted, 6) AS adapted, round(difference, 6) + 0.0 AS difference, round(observed, 6) + 0.0 AS mean_difference,
 difference_lower, difference_upper, n_extreme / n_patterns AS p_value, observed >= 0.01 AS reaches_threshold FROM sa, xf, ci""",
)
def seed_aggregate(spark, sf):
    """Per-seed differences with the seed bootstrap, the exact sign flip and a threshold flag."""
    v = seed_accuracy(spark, sf)
    flip = I.sign_flip_exact(v.withColumn("_all", F.lit(1)), ["_all"], "seed", "difference")
    draws = I.draw_table(v, "seed", "seeds", DRAWS)
    s = I.bootstrap_sums(v, "seed", [], ["difference"], draws)
    ci = I.interval(s.select((F.col("difference") / F.col("_w")).alias("difference")), [], ["difference"])
    one = flip.join(ci, F.lit(True))
    df = v.join(F.broadcast(one), F.lit(True))
    return df.select(
        F.col("seed").cast("long").alias("seed"),
        *[R(F.col(c)).alias(c) for c in ("fixed", "adapted", "difference")],
        R(F.col("observed")).alias("mean_difference"),
        R(F.col("difference_lower")).alias("difference_lower"),
        R(F.col("difference_upper")).alias("difference_upper"),
        "p_value",
        (F.col("observed") >= 0.01).alias("reaches_threshold"),
    )
