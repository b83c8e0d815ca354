"""Model queries, mechanism endpoints, method effects, representation controls."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.measures import structure_to_noise
from ..functions.peaks import detect_peaks, peak_components, range_threshold
from ..operators import align as L
from ..operators import blocks as B
from ..operators import measure as M
from ..operators import mechanism, models
from ..operators import peak_blocks as PB
from ..operators import perturb as P
from ..operators import signals as S
from ..operators import splits
from ..operators import tasks
from ..operators.quantiles import exact_quantiles
from . import observations as O
from . import sqltext as T
from .q_align import K, R9, statistics
from .q_measures import _STN
from .q_signals import SQL_SAVGOL
from .registry import query
from .tables import signals

R = A.rounded


def _roles(spark, sf):
    df = signals(spark, sf)
    r = splits.stratified(df.select("signal_id", "class_id"), "class_id", "signal_id", 10, 7)
    return df.join(r.select("signal_id", "role"), "signal_id")


@query("train_classifier")
def train_classifier(spark, sf):
    """Validation accuracy per strength, and the chosen one."""
    df = _roles(spark, sf)
    _, chosen, scores = models.train_classifier(
        df.filter(F.col("role") == "train"), df.filter(F.col("role") == "validation"), "class_id"
    )
    n = df.groupBy("role").count().filter(F.col("role") == "validation")
    cells = F.array(
        *[F.struct(F.lit(c).alias("c"), F.lit(a).alias("accuracy"), F.lit(c == chosen).alias("chosen")) for c, a in scores]
    )
    return n.select(F.col("count").alias("n_validation"), F.inline(cells)).withColumn("accuracy", R(F.col("accuracy")))


@query("score_conditions")
def score_conditions(spark, sf):
    """One trained classifier on every record under every condition."""
    df = _roles(spark, sf)
    train = df.filter(F.col("role") == "train")
    model, _, _ = models.train_classifier(train, df.filter(F.col("role") == "validation"), "class_id", grid=(1.0,))
    moved = P.perturb(df.drop("role"), T.NONAXIS)
    scored = model.transform(models.features(moved))
    hit = (F.col("prediction").cast("long") == F.col("class_id")).cast("double")
    return scored.groupBy("perturbation_id", "alpha").agg(F.count(F.lit(1)).alias("n"), R(F.avg(hit)).alias("accuracy"))


@query("pls_regression")
def pls_regression(spark, sf):
    """Two targets of each signal (its last nodes) from the others."""
    df = _roles(spark, sf).select(
        "signal_id",
        "role",
        F.slice("y", 1, 60).alias("x"),
        F.array(
            A.total(F.slice("y", 1, 20)) + F.get("y", F.lit(60)), A.total(F.slice("y", 31, 10)) - F.get("y", F.lit(61))
        ).alias("t"),
    )
    train, val = df.filter(F.col("role") == "train"), df.filter(F.col("role") == "validation")
    (b, a), k, scores = models.pls_fit(train, val, "x", "t", 60)
    out = models.pls_predict(val, "x", b, a)
    rows = F.array(*[F.struct(F.lit(f"t{j}").alias("target"), F.get("t", F.lit(j)).alias("y_true"), F.get("predicted", F.lit(j)).alias("y_pred")) for j in range(2)])
    report = tasks.regression_report(out.select(F.inline(rows)), ["target"])
    return report.select("target", "n", *[R(F.col(c)).alias(c) for c in ("rmse", "mae", "r2", "normalized_rmse")], F.lit(k).alias("components"))


def mechanism_cells(spark, sf, alphas=P.ALPHAS, own=None):
    """Peak lists of every peak-family cell next to its truth."""
    x, y = F.col("axis"), F.col("y")
    s = A.pin(signals(spark, sf) if own is None else own, {"baseline": detect_peaks(x, y, range_threshold(y))})
    s = A.pin(s, {"_pc": peak_components(x, y, F.col("baseline"))})
    s = A.pin(s, {"_fc": P.false_centres(F.col("signal_id"), x, F.col("_pc"))})
    m = P.perturb(s, ("p01", "p02", "p03", "p04", "p05"), alphas, identity=False).filter(F.col("y").isNotNull())
    n = F.size("_pc")
    weak = F.filter("_pc", lambda q: q["rank"] <= P.weak_count(F.col("alpha"), n))
    p = F.col("perturbation_id")
    return A.pin(
        m,
        {
            "candidate": detect_peaks(x, y, range_threshold(y)),
            "supports": F.when(
                p == "p02",
                F.transform(weak, lambda q: F.struct(F.get("ref_axis", q["lo"] - 1).alias("lo"), F.get("ref_axis", q["hi"] - 1).alias("hi"))),
            ).otherwise(F.array().cast("array<struct<lo:double,hi:double>>")),
            "events": F.when(p == "p04", F.transform(weak, lambda q: q["pos"]))
            .when(p == "p05", F.slice("_fc", 1, F.floor(F.col("alpha") * n).cast("int")))
            .otherwise(F.array().cast("array<double>")),
        },
    ).select("signal_id", "class_id", "perturbation_id", "alpha", "baseline", "candidate", "supports", "events")


@query("mechanism_endpoints")
def mechanism_endpoints(spark, sf):
    """Tested against a brute-force reimplementation on a small fixture."""
    own = signals(spark, sf)
    e = PB.mechanism_rows(own.select("signal_id", "class_id", "axis", "y"))
    rest = own.filter(~B.sound())
    if not rest.isEmpty():
        e = e.unionByName(mechanism.endpoints(mechanism_cells(spark, sf, own=rest)))
    return e.groupBy("perturbation_id", "alpha", "endpoint_id", "state").agg(
        F.count(F.lit(1)).alias("n"), R(F.avg("value")).alias("mean_value")
    )


# -- method effects -----------------------------------------------------------------
_METHODS = ("savgol", "snip", "morph")


def _filtered(method, x, y):
    if method == "savgol":
        return S.savgol(y)
    base = S.baseline_snip(x, y, 8.0) if method == "snip" else S.baseline_morph(x, y, 4.0)
    return A.lets({"y": y, "b": base}, lambda s: F.zip_with(s["y"], s["b"], lambda u, v: u - v))


def effects(spark, sf):
    """Candidate minus identity per class: structure-to-noise and consistency of halves."""
    x, y = F.col("axis"), F.col("y")
    runs = F.array(
        F.struct(F.lit("identity").alias("method"), y.alias("out")),
        *[F.struct(F.lit(m).alias("method"), _filtered(m, x, y).alias("out")) for m in _METHODS],
    )
    df = signals(spark, sf).select("signal_id", "class_id", F.inline(runs)).withColumnRenamed("out", "y")
    df = A.pin(df, {"y": F.col("y")})
    stn = df.groupBy("class_id", "method").agg(F.avg(structure_to_noise(F.col("y"))).alias("value"))
    stn = stn.withColumn("endpoint", F.lit("structure_to_noise"))
    keyed = df.withColumn("cell", F.concat_ws("|", "class_id", "method"))
    half = tasks.half_split(keyed, "cell", "signal_id").select(
        F.split("cell", r"\|")[0].cast("long").alias("class_id"),
        F.split("cell", r"\|")[1].alias("method"),
        F.col("consistency").alias("value"),
        F.lit("half_split").alias("endpoint"),
    )
    both = stn.unionByName(half)
    base = both.filter(F.col("method") == "identity").select("class_id", "endpoint", F.col("value").alias("_b"))
    return both.filter(F.col("method") != "identity").join(base, ["class_id", "endpoint"]).select(
        "class_id", "method", "endpoint", (F.col("value") - F.col("_b")).alias("effect")
    )


def _snip_steps(k_max=8):
    steps = ["n0 AS (SELECT signal_id, class_id, list(y ORDER BY i) AS a, any_value(n) AS n FROM sig GROUP BY ALL)"]
    for k in range(1, k_max + 1):
        steps.append(
            f"n{k} AS (SELECT signal_id, class_id, list_transform(range(1, n + 1), lambda i: least(a[i], (a[greatest(i - {k}, 1)] + a[least(i + {k}, n)]) / 2)) AS a, n FROM n{k - 1})"
        )
    return ", ".join(steps)


_EFFECTS = (
    T.SQL_SIGNALS
    + ","
    + SQL_SAVGOL
    + ", "
    + _snip_steps()
    + """, b0 AS (SELECT signal_id, i, y AS v FROM sig),
b1 AS (SELECT signal_id, i, min(v) OVER w AS v FROM b0 WINDOW w AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
b2 AS (SELECT signal_id, i, max(v) OVER w AS v FROM b1 WINDOW w AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
b3 AS (SELECT signal_id, i, least(v, (max(v) OVER w + min(v) OVER w) / 2) AS v FROM b2 WINDOW w AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
o AS MATERIALIZED (SELECT signal_id, class_id, 'identity' AS method, i, y FROM sig UNION ALL SELECT signal_id, class_id, 'savgol', i, y FROM smooth
 UNION ALL SELECT s.signal_id, s.class_id, 'snip', s.i, s.y - n8.a[s.i] FROM sig s JOIN n8 USING (signal_id)
 UNION ALL SELECT s.signal_id, s.class_id, 'morph', s.i, s.y - b3.v FROM sig s JOIN b3 USING (signal_id, i)),"""
    + _STN.format(k="signal_id, class_id, method", t="o")
    + """, e1 AS (SELECT class_id, method, 'structure_to_noise' AS endpoint, avg(v) AS value FROM stn GROUP BY ALL),
hr AS (SELECT class_id, method, i, y, dense_rank() OVER (PARTITION BY class_id, method ORDER BY signal_id) % 2 AS h FROM o),
hm AS (SELECT class_id, method, i, avg(y) FILTER (h = 1) AS a, avg(y) FILTER (h = 0) AS b FROM hr GROUP BY ALL),
e2 AS (SELECT class_id, method, 'half_split' AS endpoint, corr(a, b) AS value FROM hm GROUP BY ALL),
ea AS MATERIALIZED (SELECT * FROM e1 UNION ALL SELECT * FROM e2),
ef AS MATERIALIZED (SELECT a.class_id, a.method, a.endpoint, a.value - b.value AS effect FROM ea a JOIN ea b ON b.class_id = a.class_id AND b.endpoint = a.endpoint AND b.method = 'identity' WHERE a.method <> 'identity')"""
)


@query("method_effects", f"WITH {_EFFECTS} SELECT class_id, method, endpoint, round(effect, 6) + 0.0 AS effect FROM ef")
def method_effects(spark, sf):
    return effects(spark, sf).withColumn("effect", R(F.col("effect")))


@query(
    "family_projection",
    f"WITH {_EFFECTS} SELECT method AS family, endpoint, count(*)::BIGINT AS n_registered, count(effect)::BIGINT AS n_complete, round(median(effect), 6) + 0.0 AS median, round(min(effect), 6) + 0.0 AS min, round(max(effect), 6) + 0.0 AS max FROM ef GROUP BY ALL",
)
def family_projection(spark, sf):
    e = effects(spark, sf).withColumnRenamed("method", "family").persist()
    keys = ["family", "endpoint"]
    g = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_registered"), F.count("effect").alias("n_complete"), F.min("effect").alias("min"), F.max("effect").alias("max")
    )
    q = exact_quantiles(e, keys, "effect", {"median": 0.5})
    return g.join(q, keys).select(*keys, "n_registered", "n_complete", *[R(F.col(c)).alias(c) for c in ("median", "min", "max")])


# -- representation ------------------------------------------------------------------


def grid_pairs(spark, sf, own=None):
    """Reference and candidate of every cell on the common grid (not normalised); of all signals unless ``own`` gives some."""
    t = S.grid(*O.GRID)
    ref = A.pin(signals(spark, sf) if own is None else own, {"gr": S.resample_linear(F.col("axis"), F.col("y"), t)})
    m = P.perturb(O.grid_hits(ref), T.FAMILIES, identity=False)
    same = F.col("hits").isNotNull() & ~F.col("perturbation_id").isin("p11", "p12")
    g = F.when(same, F.transform("hits", lambda j: F.get("y", j - 1))).otherwise(S.resample_linear(F.col("axis"), F.col("y"), t))
    return A.pin(m, {"gc": g}).select("signal_id", "class_id", "perturbation_id", "alpha", "gr", "gc")


def _attach(spark, sf, x):
    y = O.class_harm(O.outcomes(spark, sf))
    return x.join(y, ["cluster_id", "perturbation_id", "alpha"])


_GM = """gp AS MATERIALIZED (SELECT a.signal_id, a.class_id AS cluster_id, a.perturbation_id, a.alpha, a.k, a.v AS c, b.v AS r FROM gv a JOIN gv b ON b.signal_id = a.signal_id AND b.k = a.k AND b.perturbation_id = 'id' WHERE a.perturbation_id <> 'id')"""


_NORMS = ("none", "max", "area", "snv")


def normalised_errors(spark, sf, own):
    """Errors of every cell of the signals ``own`` on the common grid after each normalisation, as column expressions."""
    t = S.grid(*O.GRID)
    variants = F.array(
        *[
            F.struct(
                F.lit(n).alias("variant"),
                A.lets(
                    {"a": S.normalize(t, F.col("gr"), n), "b": S.normalize(t, F.col("gc"), n)},
                    lambda s: F.zip_with(s["a"], s["b"], lambda u, v: v - u),
                ).alias("d"),
            )
            for n in _NORMS
        ]
    )
    d = grid_pairs(spark, sf, own).select(F.col("class_id").alias("cluster_id"), "perturbation_id", "alpha", F.inline(variants))
    values = F.array(
        F.struct(F.lit("mse").alias("metric"), (A.sum_squares("d") / F.size("d")).alias("h")),
        F.struct(F.lit("mae").alias("metric"), (A.total(F.transform("d", lambda v: F.abs(v))) / F.size("d")).alias("h")),
    )
    return d.select("variant", "cluster_id", "perturbation_id", "alpha", F.inline(values))


@query(
    "sensitivity",
    f"WITH {O.SQL_TASK}, {O.sql_scores()}, {_GM}, "
    + """gz AS (SELECT signal_id, cluster_id, perturbation_id, alpha, k, c, r, CASE WHEN k IN (0, 55) THEN 0.5 ELSE 1.0 END AS w FROM gp),
gd AS (SELECT signal_id, cluster_id, perturbation_id, alpha, max(c) AS cm, max(r) AS rm, sum(w * abs(c)) AS ca, sum(w * abs(r)) AS ra, avg(c) AS cv, avg(r) AS rv, stddev_pop(c) AS cs, stddev_pop(r) AS rs FROM gz GROUP BY ALL),
gn AS (SELECT signal_id, cluster_id, perturbation_id, alpha, u.variant, u.c - u.r AS d FROM (SELECT gz.signal_id, gz.cluster_id, gz.perturbation_id, gz.alpha, unnest([
 {'variant': 'none', 'c': c, 'r': r}, {'variant': 'max', 'c': CASE WHEN cm > 0 THEN c / cm END, 'r': CASE WHEN rm > 0 THEN r / rm END}, {'variant': 'area', 'c': c / ca, 'r': r / ra}, {'variant': 'snv', 'c': (c - cv) / cs, 'r': (r - rv) / rs}]) AS u
 FROM gz JOIN gd USING (signal_id, cluster_id, perturbation_id, alpha))),
ge AS (SELECT signal_id, cluster_id, perturbation_id, alpha, variant, avg(d * d) AS mse, avg(abs(d)) AS mae, max(abs(d)) AS peak FROM gn GROUP BY ALL),
"""
    + f"""xg AS (SELECT variant, cluster_id, perturbation_id, alpha, 'mse' AS metric, avg(mse) AS x FROM ge GROUP BY ALL UNION ALL SELECT variant, cluster_id, perturbation_id, alpha, 'mae', avg(mae) FROM ge GROUP BY ALL),
gl AS (SELECT variant, metric, cluster_id, perturbation_id, alpha, {O.sql_settled('x', 'variant, metric')} AS x FROM xg),
vo AS MATERIALIZED (SELECT variant, metric, cluster_id, perturbation_id, alpha, x, y FROM gl JOIN yh USING (cluster_id, perturbation_id, alpha)),"""
    + O.sql_nodes("vo", "variant, metric")
    + ","
    + O.sql_gap("variant, metric")
    + ","
    + O.sql_pairs("vo", "variant, metric")
    + " SELECT variant, metric, round(ag, 6) + 0.0 AS ag, round(oc, 9) + 0.0 AS oc FROM ag JOIN ocs USING (variant, metric)",
)
def sensitivity(spark, sf):
    """The same statistics after each normalisation of the common-grid signals."""
    x = B.mean_values(
        signals(spark, sf), "class_id", ("mse", "mae"), T.FAMILIES, O.GRID, False, lambda own: normalised_errors(spark, sf, own), _NORMS
    ).transform(M.settled, ["variant", "metric"])
    s = statistics(_attach(spark, sf, x).persist(), ["variant", "metric"])
    return s.select("variant", "metric", R(F.col("ag")).alias("ag"), R9(F.col("oc")).alias("oc"))
