"""Queries on single signals: orientation, resampling, filters, baselines, grids."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import signals as S
from ..operators.perturb import perturb
from . import sqltext as T
from .registry import query
from .tables import signals


def weighted(y):
    """Sum of i * y_i: depends on every node and on the order."""
    return A.let(y, lambda v: A.total(F.transform(v, lambda x, i: x * (i + 1))))


def checksum(y):
    return A.rounded(weighted(y))


@query(
    "orient_axis",
    "WITH "
    + T.SQL_SIGNALS
    + """SELECT signal_id, min(x) AS first_x, max(x) AS last_x, round(sum(i * y), 6) + 0.0 AS checksum
    FROM sig GROUP BY ALL""",
)
def orient_axis(spark, sf):
    """Odd signals arrive with a decreasing axis."""
    odd = F.col("signal_id") % 2 == 1
    df = signals(spark, sf).select(
        "signal_id",
        F.when(odd, F.reverse("axis")).otherwise(F.col("axis")).alias("axis"),
        F.when(odd, F.reverse("y")).otherwise(F.col("y")).alias("y"),
    )
    x, y = S.orient(F.col("axis"), F.col("y"))
    return df.select(
        "signal_id",
        F.get(x, F.lit(0)).alias("first_x"),
        F.element_at(x, -1).alias("last_x"),
        checksum(y).alias("checksum"),
    )


_TARGET = (5.0, 0.5, 111)  # 5 .. 60
_AXIS_PERT = ("p11", "p12")
_GAP = 1.05
_GRID_SQL = """,
g AS (SELECT k::BIGINT AS k, 5.0::DOUBLE + k * 0.5::DOUBLE AS t FROM range(0, 111) r(k))"""
_STATE_SQL = (
    """,
nx AS (SELECT signal_id, perturbation_id, alpha, i, x, y,
  lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2,
  lag(x) OVER w AS xm, lag(y) OVER w AS ym FROM pert
  WINDOW w AS (PARTITION BY signal_id, perturbation_id, alpha ORDER BY x)),
gs AS (SELECT signal_id, perturbation_id, alpha, CASE WHEN min(x) > 5 OR max(x) < 60 THEN 'outside_support'
  WHEN max(x1 - x) FILTER (x >= 5 AND x1 <= 60) > """
    + str(_GAP)
    + """ THEN 'native_gap' ELSE 'complete' END AS state FROM nx GROUP BY ALL)"""
)


def _resample_query(key, method, value_sql):
    sql = (
        "WITH "
        + T.perturbed(_AXIS_PERT)
        + _GRID_SQL
        + _STATE_SQL
        + f""",
v AS (SELECT n.signal_id, n.perturbation_id, n.alpha, g.k, {value_sql} AS v
  FROM nx n JOIN g ON g.t >= n.x AND g.t < n.x1),
s AS (SELECT signal_id, perturbation_id, alpha, sum((k + 1) * v) AS c FROM v GROUP BY ALL)
SELECT gs.*, CASE WHEN state = 'complete' THEN round(c, 6) + 0.0 END AS checksum
FROM gs JOIN s USING (signal_id, perturbation_id, alpha)"""
    )

    @query(key, sql)
    def run(spark, sf):
        df = perturb(signals(spark, sf), _AXIS_PERT, identity=False)
        state = S.resample_state(F.col("axis"), S.grid(*_TARGET), _GAP)
        value = S.RESAMPLERS[method](F.col("axis"), F.col("y"), S.grid(*_TARGET))
        df = A.pin(df, {"state": state}).withColumn(
            "r", F.when(F.col("state") == "complete", value)
        )
        return df.select(
            "signal_id", "perturbation_id", "alpha", "state", checksum(F.col("r")).alias("checksum")
        )


_resample_query("resample_linear", "linear", "n.y + (g.t - n.x) / (n.x1 - n.x) * (n.y1 - n.y)")
# the target range can reach the first segment of a shifted axis but never the last
_H = "(n.x1 - n.x)"
_U = f"((g.t - n.x) / {_H})"


def _slope(xm, ym, x, y, x1, y1):
    h0, h1 = f"({x} - {xm})", f"({x1} - {x})"
    m0, m1 = f"(({y} - {ym}) / {h0})", f"(({y1} - {y}) / {h1})"
    w1, w2 = f"(2 * {h1} + {h0})", f"({h1} + 2 * {h0})"
    return f"(CASE WHEN {m0} * {m1} <= 0 THEN 0 ELSE ({w1} + {w2}) / ({w1} / {m0} + {w2} / {m1}) END)"


def _first_slope():
    h0, h1 = "(n.x1 - n.x)", "(n.x2 - n.x1)"
    m0, m1 = f"((n.y1 - n.y) / {h0})", f"((n.y2 - n.y1) / {h1})"
    d = f"(((2 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}))"
    return (
        f"(CASE WHEN sign({d}) <> sign({m0}) THEN 0 WHEN sign({m0}) <> sign({m1}) AND "
        f"abs({d}) > 3 * abs({m0}) THEN 3 * {m0} ELSE {d} END)"
    )


_D0 = f"(CASE WHEN n.xm IS NULL THEN {_first_slope()} ELSE {_slope('n.xm', 'n.ym', 'n.x', 'n.y', 'n.x1', 'n.y1')} END)"
_D1 = _slope("n.x", "n.y", "n.x1", "n.y1", "n.x2", "n.y2")
_resample_query(
    "resample_pchip",
    "pchip",
    f"n.y * (1 + 2 * {_U}) * (1 - {_U}) * (1 - {_U}) + {_H} * {_D0} * {_U} * (1 - {_U}) * (1 - {_U})"
    f" + n.y1 * {_U} * {_U} * (3 - 2 * {_U}) + {_H} * {_D1} * {_U} * {_U} * ({_U} - 1)",
)


@query(
    "resample_pair",
    "WITH "
    + T.perturbed(_AXIS_PERT)
    + _GRID_SQL
    + _STATE_SQL
    + """,
v AS (SELECT n.signal_id, n.perturbation_id, n.alpha, g.k, g.t,
  n.y + (g.t - n.x) / (n.x1 - n.x) * (n.y1 - n.y) AS v FROM nx n JOIN g ON g.t >= n.x AND g.t < n.x1),
rf AS (SELECT a.signal_id, g.k, a.y + (g.t - a.x) * (b.y - a.y) AS r FROM sig a
  JOIN sig b ON b.signal_id = a.signal_id AND b.i = a.i + 1 JOIN g ON g.t >= a.x AND g.t < b.x)
SELECT v.perturbation_id, v.alpha, count(DISTINCT v.signal_id)::BIGINT AS n_pairs,
  round(avg((v.v - rf.r) * (v.v - rf.r)), 6) + 0.0 AS mean_mse
FROM v JOIN rf USING (signal_id, k) GROUP BY ALL""",
)
def resample_pair(spark, sf):
    """Reference and candidate on one grid, then the index-aligned error."""
    df = perturb(signals(spark, sf), _AXIS_PERT, identity=False)
    t = S.grid(*_TARGET)
    df = A.pin(
        df,
        {
            "a": S.resample_linear(F.col("ref_axis"), F.col("ref_y"), t),
            "b": S.resample_linear(F.col("axis"), F.col("y"), t),
        },
    )
    mse = A.sum_squares(F.zip_with("a", "b", lambda u, v: v - u)) / F.size("a")
    return (
        df.select("perturbation_id", "alpha", mse.alias("m"))
        .groupBy("perturbation_id", "alpha")
        .agg(F.count("m").alias("n_pairs"), A.rounded(F.avg("m")).alias("mean_mse"))
    )


@query(
    "grid_axis",
    "WITH "
    + T.SQL_SIGNALS
    + """, s AS (SELECT signal_id, max(x) - min(x) AS span, min(x) AS lo FROM sig GROUP BY ALL)
SELECT signal_id, (floor(span / 0.25) + 1)::BIGINT AS n_points, lo + floor(span / 0.25) * 0.25 AS last_x FROM s""",
)
def grid_axis(spark, sf):
    """Largest quarter-step grid inside each signal's support."""
    df = signals(spark, sf).select(
        "signal_id",
        F.transform(
            F.sequence(
                F.lit(0),
                F.floor((F.element_at("axis", -1) - F.get("axis", F.lit(0))) / 0.25).cast("int"),
            ),
            lambda k: F.get("axis", F.lit(0)) + k * 0.25,
        ).alias("g"),
    )
    return df.select(
        "signal_id", F.size("g").cast("long").alias("n_points"), F.element_at("g", -1).alias("last_x")
    )


@query(
    "normalize_signal",
    "WITH "
    + T.SQL_SIGNALS
    + f""", w AS (SELECT *, {T.sql_width('x', 'signal_id')} AS w FROM sig),
s AS (SELECT signal_id, sum(i * y) AS c, sum(i) AS si, max(y) AS mx, sum(w * abs(y)) AS ar, avg(y) AS m,
  stddev_pop(y) AS sd FROM w GROUP BY ALL)
SELECT signal_id, round(c, 6) + 0.0 AS none, CASE WHEN mx > 0 THEN round(c / mx, 6) + 0.0 END AS max,
  CASE WHEN ar > 0 THEN round(c / ar, 6) + 0.0 END AS area, round((c - si * m) / sd, 6) + 0.0 AS snv FROM s""",
)
def normalize_signal(spark, sf):
    x, y = F.col("axis"), F.col("y")
    return signals(spark, sf).select(
        "signal_id",
        *[checksum(S.normalize(x, y, m)).alias(m) for m in ("none", "max", "area", "snv")],
    )


@query(
    "l2_normalize",
    "WITH "
    + T.SQL_SIGNALS
    + """SELECT signal_id, round(sum(i * y) / sqrt(sum(y * y)), 6) + 0.0 AS checksum FROM sig GROUP BY ALL""",
)
def l2_normalize(spark, sf):
    return signals(spark, sf).select(
        "signal_id", checksum(A.l2_normalize(F.col("y"))).alias("checksum")
    )


@query(
    "trapezoid_weights",
    "WITH "
    + T.perturbed(("p12",))
    + f""", w AS (SELECT signal_id, alpha, y, {T.sql_width('x', 'signal_id, alpha')} AS w FROM pert)
SELECT signal_id, alpha, round(sum(w), 6) + 0.0 AS total_width, round(sum(w * y), 6) + 0.0 AS area
FROM w GROUP BY ALL""",
)
def trapezoid_weights(spark, sf):
    df = perturb(signals(spark, sf), ("p12",), identity=False)
    return df.select(
        "signal_id",
        "alpha",
        A.rounded(A.total(A.node_widths("axis"))).alias("total_width"),
        A.rounded(A.trapezoid(F.col("axis"), F.col("y"))).alias("area"),
    )


_SG = ", ".join(
    f"({r}, {c}, {float(v)!r}::DOUBLE)" for r, row in enumerate(S.savgol_matrix()) for c, v in enumerate(row)
)
SQL_SAVGOL = f"""
sg AS (SELECT * FROM (VALUES {_SG}) t(r, c, w)),
smooth AS (SELECT a.signal_id, a.class_id, a.i, a.x, sum(sg.w * b.y) AS y
  FROM (SELECT *, least(greatest(i - 6, 0), n - 11) AS st FROM sig) a
  JOIN sg ON sg.r = a.i - 1 - a.st JOIN sig b ON b.signal_id = a.signal_id AND b.i = a.st + 1 + sg.c
  GROUP BY ALL)"""


@query(
    "savgol",
    "WITH "
    + T.SQL_SIGNALS
    + ","
    + SQL_SAVGOL
    + "SELECT signal_id, round(sum(i * y), 6) + 0.0 AS checksum, round(max(y), 6) + 0.0 AS top FROM smooth GROUP BY ALL",
)
def savgol(spark, sf):
    df = A.pin(signals(spark, sf), {"s": S.savgol(F.col("y"))})
    return df.select(
        "signal_id", checksum(F.col("s")).alias("checksum"), A.rounded(F.array_max("s")).alias("top")
    )


def _roll(agg, col, src, name, h=4):
    return (
        f"{name} AS (SELECT signal_id, i, y0, {agg}({col}) OVER (PARTITION BY signal_id ORDER BY i "
        f"ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS v FROM {src})"
    )


@query(
    "baseline_morph",
    "WITH "
    + T.SQL_SIGNALS
    + ", b0 AS (SELECT signal_id, i, y AS y0, y AS v FROM sig), "
    + ", ".join(
        [
            _roll("min", "v", "b0", "b1"),
            _roll("max", "v", "b1", "b2"),
            _roll("max", "v", "b2", "b3"),
            _roll("min", "v", "b2", "b4"),
        ]
    )
    + """SELECT b2.signal_id, round(sum(b2.i * (b2.y0 - least(b2.v, (b3.v + b4.v) / 2))), 6) + 0.0 AS corrected
    FROM b2 JOIN b3 USING (signal_id, i) JOIN b4 USING (signal_id, i) GROUP BY ALL""",
)
def baseline_morph(spark, sf):
    df = A.pin(signals(spark, sf), {"b": S.baseline_morph(F.col("axis"), F.col("y"), 4.0)})
    corrected = F.zip_with("y", "b", lambda u, v: u - v)
    return df.select("signal_id", checksum(corrected).alias("corrected"))


def _snip_sql(k_max):
    steps = ["n0 AS (SELECT signal_id, list(y ORDER BY i) AS a, any_value(n) AS n FROM sig GROUP BY ALL)"]
    for k in range(1, k_max + 1):
        steps.append(
            f"n{k} AS (SELECT signal_id, list_transform(range(1, n + 1), lambda i: least(a[i], "
            f"(a[greatest(i - {k}, 1)] + a[least(i + {k}, n)]) / 2)) AS a, n FROM n{k - 1})"
        )
    return (
        "WITH "
        + T.SQL_SIGNALS
        + ", "
        + ", ".join(steps)
        + f""" SELECT signal_id, round(list_sum(list_transform(range(1, n + 1), lambda i: i * a[i])), 6) + 0.0
        AS baseline FROM n{k_max}"""
    )


@query("baseline_snip", _snip_sql(8))
def baseline_snip(spark, sf):
    return signals(spark, sf).select(
        "signal_id", checksum(S.baseline_snip(F.col("axis"), F.col("y"), 8.0)).alias("baseline")
    )


def _pinv_values(n=64, degree=6):
    u = 2 * np.arange(n) / (n - 1) - 1
    design = np.polynomial.legendre.legvander(u, degree)
    inv = np.linalg.pinv(design)
    a = ", ".join(f"({k}, {j + 1}, {float(inv[k, j])!r}::DOUBLE, {float(design[j, k])!r}::DOUBLE)" for k in range(degree + 1) for j in range(n))
    return f"pv AS (SELECT * FROM (VALUES {a}) t(k, i, w, p))"


@query(
    "poly_background",
    "WITH "
    + T.SQL_SIGNALS
    + ", "
    + _pinv_values()
    + """,
q0 AS (SELECT *, y - min(y) OVER (PARTITION BY signal_id) AS q FROM sig),
q1 AS (SELECT *, sqrt(avg(q * q) OVER p) AS qr, sqrt(avg(y * y) OVER p) AS tr FROM q0 WINDOW p AS (PARTITION BY signal_id)),
cf AS (SELECT signal_id, k, sum(w * q / qr) AS c FROM q1 JOIN pv USING (i) GROUP BY ALL),
rc AS (SELECT signal_id, i, sum(c * p) AS r FROM cf JOIN pv USING (k) GROUP BY ALL)
SELECT q1.signal_id, round(sqrt(avg((r - q / qr) * (r - q / qr))), 6) + 0.0 AS nrmse,
  round(any_value(ln(qr / tr)), 6) + 0.0 AS log_ratio,
  round(any_value(c2.c), 6) + 0.0 AS c2, round(any_value(c6.c), 6) + 0.0 AS c6
FROM q1 JOIN rc USING (signal_id, i) JOIN cf c2 ON c2.signal_id = q1.signal_id AND c2.k = 2
JOIN cf c6 ON c6.signal_id = q1.signal_id AND c6.k = 6 GROUP BY ALL""",
)
def poly_background(spark, sf):
    df = signals(spark, sf).select(
        "signal_id", S.poly_background(F.col("y"), F.col("y"), F.col("axis")).alias("b")
    )
    return df.select(
        "signal_id",
        A.rounded(F.col("b.nrmse")).alias("nrmse"),
        A.rounded(F.col("b.log_ratio")).alias("log_ratio"),
        A.rounded(F.get("b.coefficients", F.lit(2))).alias("c2"),
        A.rounded(F.get("b.coefficients", F.lit(6))).alias("c6"),
    )


@query("pca_denoise")
def pca_denoise(spark, sf):
    """Reconstruction error of 20 components per class; tested against numpy."""
    df = signals(spark, sf)
    out = S.pca_reconstruct(df, df, 20)
    err = A.rms(F.zip_with("y", "reconstructed", lambda u, v: u - v))
    return (
        out.select("class_id", err.alias("e"))
        .groupBy("class_id")
        .agg(F.count("e").alias("n"), A.rounded(F.avg("e")).alias("mean_rms_error"))
    )


# The widths tried per baseline method, in axis units.
FAMILIES = {"morph": {"width": [2.0, 4.0, 8.0, 40.0]}, "snip": {"width": [4.0, 8.0, 16.0, 40.0]}}


def _system_values():
    rows = []
    for m, axes in FAMILIES.items():
        for w in axes["width"]:
            text = f"{m}|width={w:.6f}"
            rows.append(f"('{m}', {w}::DOUBLE, '{hashlib.sha256(text.encode()).hexdigest()[:16]}')")
    return f"sy AS (SELECT * FROM (VALUES {', '.join(rows)}) t(method, width, system_id))"


@query(
    "param_grid",
    "WITH "
    + T.SQL_SIGNALS
    + ", "
    + _system_values()
    + """, s AS (SELECT signal_id, any_value(n) AS n FROM sig GROUP BY ALL)
SELECT system_id, method, width, count_if(width <= (n - 1) // 2)::BIGINT AS n_applicable FROM sy, s GROUP BY ALL""",
)
def param_grid(spark, sf):
    """Every setting with the number of signals whose axis admits it."""
    limits = signals(spark, sf).select(
        A.median(A.differences("axis")).alias("dx"), F.floor((F.size("axis") - 1) / 2).alias("m")
    )
    # counted per distinct (spacing, limit) first, so the settings multiply kinds, not signals
    kinds = limits.groupBy("dx", "m").count()
    df = kinds.select("*", F.inline(S.param_grid(FAMILIES))).withColumn(
        "width", F.col("parameters")["width"]
    )
    points = F.rint(F.col("width") / F.col("dx"))
    applicable = F.when((points >= 1) & (points <= F.col("m")), F.col("count")).otherwise(0)
    return df.groupBy("system_id", "method", "width").agg(F.sum(applicable).alias("n_applicable"))


@query(
    "method_coverage",
    "WITH "
    + T.SQL_SIGNALS
    + """, m AS (SELECT * FROM (VALUES ('morph', 4.0), ('morph', 40.0), ('snip', 8.0), ('snip', 40.0)) t(method, width)),
s AS (SELECT signal_id, any_value(n) AS n FROM sig GROUP BY ALL),
c AS (SELECT method, width::DOUBLE AS width, count(*)::BIGINT AS n_total, count_if(width <= (n - 1) // 2)::BIGINT AS n_complete FROM m, s GROUP BY ALL)
SELECT *, (n_total - n_complete)::BIGINT AS n_not_applicable, round(n_complete / n_total, 6) + 0.0 AS success_fraction,
  n_complete / n_total >= 0.99 AS passes FROM c""",
)
def method_coverage(spark, sf):
    df = signals(spark, sf)
    x, y = F.col("axis"), F.col("y")
    runs = [("morph", 4.0), ("morph", 40.0), ("snip", 8.0), ("snip", 40.0)]
    build = {"morph": S.baseline_morph, "snip": S.baseline_snip}
    status = F.array(
        *[
            F.struct(
                F.lit(m).alias("method"),
                F.lit(w).alias("width"),
                A.let(
                    build[m](x, y, w),
                    lambda b: F.when(b.isNull(), "not_applicable")
                    .when(F.exists(b, lambda v: F.isnan(v) | v.isNull()), "failed")
                    .otherwise("complete"),
                ).alias("status"),
            )
            for m, w in runs
        ]
    )
    df = df.select(F.explode(status).alias("s")).select("s.*")
    df = df.groupBy("method", "width").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("status") == "complete").alias("n_complete"),
        F.count_if(F.col("status") == "not_applicable").alias("n_not_applicable"),
    )
    share = F.col("n_complete") / F.col("n_total")
    return df.withColumns({"success_fraction": A.rounded(share), "passes": share >= 0.99})
