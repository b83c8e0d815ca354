"""Queries on signal pairs, regions and peak sets."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.measures import MEASURES, Pair, negative_area, structure_to_noise
from ..functions.peak_counts import peak_outputs
from ..functions.peaks import detect_peaks, match_peaks, range_threshold, ratios
from ..operators import measure as M
from ..operators import peak_blocks as PB
from ..operators.blocks import sound
from ..operators.perturb import perturb
from . import sqltext as T
from .registry import query
from .tables import signals



def pair() -> Pair:
    return Pair(F.col("ref_axis"), F.col("ref_y"), F.col("axis"), F.col("y"))


def _condition_mean(df, value):
    return (
        df.select("class_id", "perturbation_id", "alpha", value.alias("v"))
        .groupBy("class_id", "perturbation_id", "alpha")
        .agg(F.count("v").alias("n_defined"), A.rounded(F.avg("v")).alias("mean_value"))
    )


def _pair_query(key, perturbations, value_fn, sql_pair):
    """Mean of one measure per (class, condition) over every signal."""
    sql = (
        "WITH "
        + T.perturbed(perturbations)
        + f""",
m AS (SELECT signal_id, class_id, perturbation_id, alpha, {sql_pair} AS v FROM pert GROUP BY ALL)
SELECT class_id, perturbation_id, alpha, count(v)::BIGINT AS n_defined, round(avg(v), 6) + 0.0 AS mean_value
FROM m GROUP BY ALL"""
    )

    @query(key, sql)
    def run(spark, sf):
        df = perturb(signals(spark, sf), perturbations, identity=False)
        return _condition_mean(df, value_fn(pair()))

    return run


_pair_query("measure_mse", T.FAMILIES, MEASURES["mse"].expression, "avg((y - ry) * (y - ry))")
_pair_query("measure_rmse", T.NONAXIS, MEASURES["rmse"].expression, "sqrt(avg((y - ry) * (y - ry)))")
_pair_query("measure_mae", T.NONAXIS, MEASURES["mae"].expression, "avg(abs(y - ry))")
_pair_query(
    "measure_nmse", T.NONAXIS, MEASURES["nmse"].expression, "sum((y - ry) * (y - ry)) / sum(ry * ry)"
)
_pair_query(
    "measure_sam",
    T.NONAXIS,
    MEASURES["sam"].expression,
    "acos(greatest(-1.0, least(1.0, sum(y * ry) / (sqrt(sum(ry * ry)) * sqrt(sum(y * y))))))",
)
_pair_query("measure_pearson", T.NONAXIS, MEASURES["pearson"].expression, "corr(y, ry)")

_W1 = (
    "WITH "
    + T.perturbed(T.FAMILIES)
    + f""",
g AS (SELECT *, {T.sql_width('x', 'signal_id, perturbation_id, alpha')} * greatest(y, 0) AS mc,
      {T.sql_width('rx', 'signal_id, perturbation_id, alpha')} * greatest(ry, 0) AS mr FROM pert),
h AS (SELECT *, sum(mc) OVER p AS tc, sum(mr) OVER p AS tr FROM g
      WINDOW p AS (PARTITION BY signal_id, perturbation_id, alpha)),
e AS (SELECT signal_id, class_id, perturbation_id, alpha, x, mc / tc AS m FROM h
      UNION ALL SELECT signal_id, class_id, perturbation_id, alpha, rx, -mr / tr FROM h),
f AS (SELECT signal_id, class_id, perturbation_id, alpha, x, sum(m) AS m FROM e GROUP BY ALL),
r AS (SELECT *, sum(m) OVER (PARTITION BY signal_id, perturbation_id, alpha ORDER BY x) AS cdf,
      lead(x) OVER (PARTITION BY signal_id, perturbation_id, alpha ORDER BY x) - x AS dx FROM f),
w AS (SELECT signal_id, class_id, perturbation_id, alpha, sum(abs(cdf) * dx) AS v FROM r GROUP BY ALL)
SELECT class_id, perturbation_id, alpha, count(v)::BIGINT AS n_defined, round(avg(v), 6) + 0.0 AS mean_value
FROM w GROUP BY ALL"""
)


@query("measure_w1", _W1)
def measure_w1(spark, sf):
    df = perturb(signals(spark, sf), T.FAMILIES, identity=False)
    return _condition_mean(df, MEASURES["wasserstein_1"].expression(pair()))


@query(
    "negative_area",
    "WITH "
    + T.perturbed(("p08", "p12"))
    + f""",
g AS (SELECT signal_id, class_id, perturbation_id, alpha, y,
      {T.sql_width('x', 'signal_id, perturbation_id, alpha')} AS w FROM pert),
m AS (SELECT signal_id, class_id, perturbation_id, alpha,
      sum(w * greatest(-y, 0)) / sum(w * abs(y)) AS v FROM g GROUP BY ALL)
SELECT class_id, perturbation_id, alpha, count(v)::BIGINT AS n_defined, round(avg(v), 6) + 0.0 AS mean_value
FROM m GROUP BY ALL""",
)
def negative_area_query(spark, sf):
    df = perturb(signals(spark, sf), ("p08", "p12"), identity=False)
    return _condition_mean(df, negative_area(F.col("axis"), F.col("y")))


_STN = """
d AS (SELECT {k}, y, lead(y) OVER (PARTITION BY {k} ORDER BY i) - y AS d FROM {t}),
d_s AS (SELECT {k}, stddev_pop(y) AS s, quantile_cont(d, 0.5) AS md, count(*) AS n FROM d GROUP BY ALL),
d_v AS (SELECT {k}, any_value(d_s.s) AS s, any_value(d_s.n) AS n,
      quantile_cont(abs(d.d - d_s.md), 0.5) / (0.6744897501960817 * sqrt(2)) AS noise
      FROM d JOIN d_s USING ({k}) GROUP BY ALL),
stn AS (SELECT {k}, CASE WHEN n >= 3 AND noise > 0 THEN s / noise END AS v FROM d_v)"""


@query(
    "measure_stn",
    "WITH "
    + T.perturbed(T.NONAXIS)
    + ","
    + _STN.format(k="signal_id, class_id, perturbation_id, alpha", t="pert")
    + """
SELECT class_id, perturbation_id, alpha, count(v)::BIGINT AS n_defined, round(avg(v), 6) + 0.0 AS mean_value
FROM stn GROUP BY ALL""",
)
def measure_stn(spark, sf):
    df = perturb(signals(spark, sf), T.NONAXIS, identity=False)
    return _condition_mean(df, structure_to_noise(F.col("y")))


# -- regions -----------------------------------------------------------------
# Per-signal regions derived from the data: signal = around the maximum,
# noise/reference = the half of the axis the maximum is not in, at its far end.


def with_regions(df):
    """Region list per signal: 9 nodes around the maximum and 16 far nodes."""
    top = F.array_position("y", F.array_max("y")).cast("double")
    n = F.size("y")
    far_lo = F.when(top > n / 2, F.lit(1.0)).otherwise((n - 15).cast("double"))

    def region(role, lo, hi):
        return F.struct(F.lit(role).alias("role"), lo.alias("lo"), hi.alias("hi"))

    return df.withColumn(
        "regions",
        F.array(
            region("signal", F.greatest(top - 4, F.lit(1.0)), F.least(top + 4, n.cast("double"))),
            region("noise", far_lo, far_lo + 15),
            region("reference", far_lo, far_lo + 15),
        ),
    )


_REGION = (
    "WITH "
    + T.SQL_SIGNALS
    + """,
top AS (SELECT signal_id, class_id, arg_max(x, y) AS t, any_value(n)::DOUBLE AS n FROM sig GROUP BY ALL),
reg AS (
  SELECT signal_id, class_id, 'signal' AS role, greatest(t - 4, 1.0) AS lo, least(t + 4, n) AS hi FROM top
  UNION ALL SELECT signal_id, class_id, r.role, CASE WHEN t > n / 2 THEN 1.0 ELSE n - 15 END,
    CASE WHEN t > n / 2 THEN 16.0 ELSE n END FROM top, (VALUES ('noise'), ('reference')) r(role)
),
rn AS (SELECT r.signal_id, r.class_id, r.role, r.lo, r.hi, s.x, s.y FROM reg r JOIN sig s
       ON s.signal_id = r.signal_id AND s.x BETWEEN r.lo AND r.hi),
rs AS (SELECT signal_id, class_id,
  max(y) FILTER (role = 'signal') AS smax, avg(y) FILTER (role = 'signal') AS smean,
  avg(y) FILTER (role = 'noise') AS nmean, stddev_pop(y) FILTER (role = 'noise') AS nstd FROM rn GROUP BY ALL)
"""
)


@query(
    "region_mask",
    _REGION
    + """SELECT signal_id, role, count(*)::BIGINT AS n_points, round(sum(y), 6) + 0.0 AS sum_y,
      count(*) >= 2 AS enough_points FROM rn GROUP BY ALL""",
)
def region_mask(spark, sf):
    df = with_regions(signals(spark, sf)).select(
        "signal_id", "axis", "y", F.explode("regions").alias("r")
    )
    inside = M.region_values(F.col("axis"), F.col("y"), F.col("r.lo"), F.col("r.hi"))
    return df.withColumn("v", inside).select(
        "signal_id",
        F.col("r.role").alias("role"),
        F.size("v").cast("long").alias("n_points"),
        A.rounded(A.total(F.transform("v", lambda p: p["y"]))).alias("sum_y"),
        (F.size("v") >= 2).alias("enough_points"),
    )


@query(
    "region_conflicts",
    _REGION
    + """, wide AS (SELECT signal_id, role, lo, hi + CASE WHEN signal_id % 7 = 0 AND role = 'signal'
      THEN 40 ELSE 0 END AS hi FROM reg)
SELECT a.signal_id, a.role AS left_role, b.role AS right_role FROM wide a JOIN wide b
 ON a.signal_id = b.signal_id AND a.role < b.role AND a.lo <= b.hi AND b.lo <= a.hi
WHERE 'signal' IN (a.role, b.role)""",
)
def region_conflicts(spark, sf):
    """Touching signal and noise/reference regions; every seventh signal is widened."""
    df = with_regions(signals(spark, sf)).withColumn(
        "regions",
        F.transform(
            "regions",
            lambda r: F.struct(
                r["role"].alias("role"),
                r["lo"].alias("lo"),
                (
                    r["hi"]
                    + F.when((F.col("signal_id") % 7 == 0) & (r["role"] == "signal"), 40.0).otherwise(0.0)
                ).alias("hi"),
            ),
        ),
    )
    return M.region_conflicts(df)


def _snr(key, column, sql):
    @query(key, _REGION + sql)
    def run(spark, sf):
        df = M.snr(with_regions(signals(spark, sf)))
        return df.select("signal_id", A.rounded(F.col(column)).alias(column))

    return run


_snr("snr_peak", "snr_peak", "SELECT signal_id, round((smax - nmean) / nstd, 6) + 0.0 AS snr_peak FROM rs")
_snr(
    "snr_mean",
    "snr_mean",
    "SELECT signal_id, round((smean - nmean) / nstd, 6) + 0.0 AS snr_mean FROM rs",
)
_snr(
    "snr_area",
    "snr_area",
    f""", sw AS (SELECT *, {T.sql_width('x', 'signal_id')} AS w FROM rn WHERE role = 'signal')
SELECT sw.signal_id, round(sum(sw.w * (sw.y - rs.nmean)) / (any_value(rs.nstd) * sqrt(sum(sw.w * sw.w))), 6) + 0.0
  AS snr_area FROM sw JOIN rs USING (signal_id) GROUP BY ALL""",
)

# -- peak sets ---------------------------------------------------------------

_THR = "0.05 * (s.ymax - s.ymin)"
_PEAK_CONDITIONS = T.FAMILIES
_SCAN_CONDITIONS = ("p09", "p10")  # whole peak tables are made only for these
_TOLERANCES, _CUTS = (1.0, 2.0, 4.0, 8.0), (0.0, 0.1)


def _detected(y="y", axis="axis"):
    return detect_peaks(F.col(axis), F.col(y), range_threshold(F.col(y)))


def peak_pairs(own, perturbations=_SCAN_CONDITIONS):
    """Reference and candidate peak lists of every cell."""
    df = A.pin(own, {"ref_peaks": _detected()})
    return A.pin(perturb(df, perturbations, identity=False), {"peaks": _detected()})


_PAIR_KEY = "signal_id, perturbation_id, alpha"
def _peak_sql(conditions):
    return (
        "WITH "
        + T.perturbed(conditions)
        + ","
        + T.sql_peaks("pert", "signal_id, class_id, perturbation_id, alpha", _THR, "ck")
        + ","
        + T.sql_peaks("sig", "signal_id", _THR, "rk0")
        + """, rk AS (SELECT c.perturbation_id, c.alpha, rk0.* FROM rk0, cond c),
cells AS (SELECT DISTINCT signal_id, class_id, perturbation_id, alpha FROM pert)"""
    )


_PEAK_SQL = _peak_sql(_SCAN_CONDITIONS)
_COUNTS = """
nr AS (SELECT {k}, count(*) AS n_ref FROM {r} GROUP BY ALL),
nc AS (SELECT {k}, count(*) AS n_cand FROM {c} GROUP BY ALL),
nm AS (SELECT {k}, count(*) AS n_match FROM mt GROUP BY ALL),
cnt AS (SELECT cells.*, coalesce(n_ref, 0)::BIGINT AS n_ref, coalesce(n_cand, 0)::BIGINT AS n_cand,
   coalesce(n_match, 0)::BIGINT AS n_match
   FROM {cells} cells LEFT JOIN nr USING ({k}) LEFT JOIN nc USING ({k}) LEFT JOIN nm USING ({k})),
rat AS (SELECT *, CASE WHEN n_cand = 0 THEN 1.0 ELSE n_match::DOUBLE / n_cand END AS peak_precision,
   CASE WHEN n_ref = 0 THEN 1.0 ELSE n_match::DOUBLE / n_ref END AS peak_recall,
   CASE WHEN n_ref + n_cand = 0 THEN 1.0 ELSE 2.0 * n_match::DOUBLE / (n_ref + n_cand) END AS peak_f1,
   CASE WHEN n_cand = 0 THEN 0.0 ELSE (n_cand - n_match)::DOUBLE / n_cand END AS artifact_ratio,
   CASE WHEN n_ref = 0 THEN 0.0 ELSE (n_ref - n_match)::DOUBLE / n_ref END AS missing_ratio FROM cnt)"""
_OUTPUTS = ("peak_precision", "peak_recall", "peak_f1", "artifact_ratio", "missing_ratio")
_AVG_SQL = ", ".join(f"round(avg({o}), 6) + 0.0 AS {o}" for o in _OUTPUTS)


@query(
    "measure_peaks",
    _peak_sql(_PEAK_CONDITIONS)
    + ","
    + T.sql_match("rk", "ck", _PAIR_KEY, "2.0", "mt")
    + ","
    + _COUNTS.format(k=_PAIR_KEY, r="rk", c="ck", cells="cells")
    + f"""
SELECT class_id, perturbation_id, alpha, sum(n_match)::BIGINT AS n_match, {_AVG_SQL} FROM rat GROUP BY ALL""",
)
def measure_peaks(spark, sf):
    df = perturb(signals(spark, sf), _PEAK_CONDITIONS, identity=False).withColumn("c", peak_outputs(pair()))
    df = A.pin(df, {"r": ratios(F.col("c.n_ref"), F.col("c.n_cand"), F.col("c.n_match")), "m": F.col("c.n_match")})
    return df.groupBy("class_id", "perturbation_id", "alpha").agg(
        F.sum("m").alias("n_match"), *[A.rounded(F.avg(f"r.{o}")).alias(o) for o in _OUTPUTS]
    )


@query(
    "peak_scans",
    _PEAK_SQL
    + """,
tol AS (SELECT t::DOUBLE AS tolerance, p::DOUBLE AS min_prominence FROM (VALUES (1.0),(2.0),(4.0),(8.0)) a(t), (VALUES (0.0),(0.1)) b(p)),
rt AS (SELECT tol.*, * EXCLUDE (ord), row_number() OVER (PARTITION BY tolerance, min_prominence, """
    + _PAIR_KEY
    + """ ORDER BY pos) AS ord FROM rk, tol WHERE prom >= min_prominence),
ct AS (SELECT tol.*, * EXCLUDE (ord), row_number() OVER (PARTITION BY tolerance, min_prominence, """
    + _PAIR_KEY
    + """ ORDER BY pos) AS ord FROM ck, tol WHERE prom >= min_prominence),
cell2 AS (SELECT cells.*, tol.* FROM cells, tol),"""
    + T.sql_match("rt", "ct", _PAIR_KEY + ", tolerance, min_prominence", "tolerance", "mt")
    + ","
    + _COUNTS.format(
        k=_PAIR_KEY + ", tolerance, min_prominence", r="rt", c="ct", cells="cell2"
    )
    + f"""
SELECT tolerance, min_prominence, perturbation_id, alpha, sum(n_match)::BIGINT AS n_match, {_AVG_SQL}
FROM rat GROUP BY ALL""",
)
def peak_scans(spark, sf):
    """Tolerance scan crossed with a prominence cut on both sides."""
    own = signals(spark, sf)
    parts = PB.scan_sums(own, _SCAN_CONDITIONS, _TOLERANCES, _CUTS)
    rest = own.filter(~sound())
    if not rest.isEmpty():
        parts = parts.unionByName(scanned(rest))
    n = F.sum("n_cells")
    return parts.groupBy("tolerance", "min_prominence", "perturbation_id", "alpha").agg(
        F.sum("n_match").alias("n_match"), *[A.rounded(F.when(n > 0, F.sum(o) / n)).alias(o) for o in _OUTPUTS]
    )


def scanned(own):
    """:func:`PB.scan_sums` of signals of any kind; a signal without peak lists counts in no mean."""
    df = peak_pairs(own)
    grid = F.array(
        *[F.struct(F.lit(t).alias("tolerance"), F.lit(p).alias("min_prominence")) for t in _TOLERANCES for p in _CUTS]
    )
    df = df.select("signal_id", "perturbation_id", "alpha", "ref_peaks", "peaks", F.explode(grid).alias("g"))
    df = df.select(
        "perturbation_id",
        "alpha",
        "g.*",
        F.filter("ref_peaks", lambda p: p["prom"] >= F.col("g.min_prominence")).alias("a"),
        F.filter("peaks", lambda p: p["prom"] >= F.col("g.min_prominence")).alias("b"),
    )
    df = A.pin(df, {"m": F.size(match_peaks(F.col("a"), F.col("b"), F.col("tolerance")))})
    df = df.withColumn("r", ratios(F.size("a"), F.size("b"), F.col("m")))
    return df.groupBy("tolerance", "min_prominence", "perturbation_id", "alpha").agg(
        F.count("r.peak_f1").alias("n_cells"), F.sum("m").cast("long").alias("n_match"), *[F.sum(f"r.{o}").alias(o) for o in _OUTPUTS]
    )


@query(
    "matched_peak_errors",
    _PEAK_SQL
    + ","
    + T.sql_match("rk", "ck", _PAIR_KEY, "2.0", "mt")
    + f""",
er AS (SELECT mt.{_PAIR_KEY.replace(', ', ', mt.')}, avg(mt.d) AS pe, avg(abs(b.height - a.height) / abs(a.height)) AS he,
   avg(abs(b.fwhm - a.fwhm)) AS we, avg(abs(b.area - a.area)) AS ae
   FROM mt JOIN rk a ON a.signal_id = mt.signal_id AND a.perturbation_id = mt.perturbation_id AND a.alpha = mt.alpha AND a.ord = mt.l
   JOIN ck b ON b.signal_id = mt.signal_id AND b.perturbation_id = mt.perturbation_id AND b.alpha = mt.alpha AND b.ord = mt.r
   GROUP BY ALL)
SELECT perturbation_id, alpha, count(*)::BIGINT AS n_pairs, round(avg(pe), 6) + 0.0 AS position_error,
  round(avg(he), 6) + 0.0 AS relative_height_error, round(avg(we), 6) + 0.0 AS fwhm_error,
  round(avg(ae), 6) + 0.0 AS area_error FROM er GROUP BY ALL""",
)
def matched_peak_errors(spark, sf):
    own = signals(spark, sf)
    parts = PB.error_sums(own, _SCAN_CONDITIONS)
    rest = own.filter(~sound())
    if not rest.isEmpty():
        df = M.matched_errors(peak_pairs(rest), tolerance=2.0).groupBy("perturbation_id", "alpha")
        counts = [F.count(e).alias(f"n_{e}") for e in PB.ERRORS]
        parts = parts.unionByName(df.agg(*counts, *[F.sum(e).alias(e) for e in PB.ERRORS]))
    means = [A.rounded(F.try_divide(F.sum(e), F.sum(f"n_{e}"))).alias(e) for e in PB.ERRORS]
    found = parts.groupBy("perturbation_id", "alpha").agg(F.sum("n_position_error").alias("n_pairs"), *means)
    return found.filter(F.col("n_pairs") > 0)
