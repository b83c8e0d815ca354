"""Hand-derived values for single operators."""

import math

import pytest
from pyspark.sql import functions as F

from signalharm.functions import arrays as A
from signalharm.functions.measures import MEASURES, Pair, negative_area, structure_to_noise
from signalharm.functions.peaks import match_peaks, ratios
from signalharm.operators import align as L
from signalharm.operators import infer as I
from signalharm.operators import measure as M
from signalharm.operators import tasks



def P():
    return Pair(F.col("ref_axis"), F.col("ref_y"), F.col("axis"), F.col("y"))

PAIR = "ref_axis array<double>, ref_y array<double>, axis array<double>, y array<double>"


def one(spark, row, schema, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()[0]


def pair(spark, output, ra, ry, a, y):
    f = lambda v: [float(x) for x in v]
    return one(spark, (f(ra), f(ry), f(a), f(y)), PAIR, MEASURES[output].expression(P()))


@pytest.mark.parametrize(
    "output,value",
    [
        ("mse", 5.25),
        ("rmse", math.sqrt(5.25)),
        ("mae", 1.75),
        ("nmse", 0.7),
        ("sam", math.acos(43 / (math.sqrt(30) * math.sqrt(77)))),
        ("pearson", 21 / math.sqrt(695)),
    ],
)
def test_paired(spark, output, value):
    x = [100, 200, 300, 400]
    assert pair(spark, output, x, [1, 2, 3, 4], x, [2, 0, 3, 8]) == pytest.approx(value, abs=1e-12)


@pytest.mark.parametrize(
    "ra,ry,a,y,value",
    [
        ([0, 1, 2], [2, 0, 0], [0, 1, 2], [0, 2, 0], 1.0),
        ([0, 2], [1, 1], [0, 1, 2], [2, 0, 2], 0.0),
        ([0, 1, 2], [0, 2, 0], [0.8, 1.8, 2.8], [0, 2, 0], 0.8),
        ([0, 1, 2], [-1, 2, -1], [0, 1, 2], [0, 2, 0], 0.0),
    ],
)
def test_transport(spark, ra, ry, a, y, value):
    assert pair(spark, "wasserstein_1", ra, ry, a, y) == pytest.approx(value, abs=1e-12)


def test_undefined_is_null(spark):
    x = [0, 1, 2]
    assert pair(spark, "wasserstein_1", x, [-1, -1, -1], x, [0, 2, 0]) is None
    assert pair(spark, "pearson", x, [1, 1, 1], x, [0, 2, 0]) is None
    assert pair(spark, "nmse", x, [0, 0, 0], x, [0, 2, 0]) is None
    assert pair(spark, "structure_to_noise", x, [0, 1, 2], x, [0, 1, 2]) is None


def test_reference_free(spark):
    s = "axis array<double>, y array<double>"
    v = one(spark, ([0.0, 1.0, 2.0, 3.0], [0.0, 2.0, 0.0, 4.0]), s, structure_to_noise(F.col("y")))
    assert v == pytest.approx((math.sqrt(11) / 2) / (2 / 0.6744897501960817 / math.sqrt(2)), abs=1e-12)
    v = one(spark, ([0.0, 1.0, 2.0], [-1.0, 2.0, -1.0]), s, negative_area(F.col("axis"), F.col("y")))
    assert v == pytest.approx(1 / 3)


def test_region_snr(spark):
    axis = [float(v) for v in (0, 1, 2, 4, 5, 7, 8, 9, 10)]
    y = [float(v) for v in (1, 0, 3, 5, 2, 1, 0, 2, 1)]
    regions = [("signal", 2.0, 5.0), ("noise", 8.0, 10.0), ("reference", 8.0, 10.0)]
    df = spark.createDataFrame(
        [(1, axis, y, regions)],
        "signal_id long, axis array<double>, y array<double>, regions array<struct<role:string,lo:double,hi:double>>",
    )
    r = M.snr(df).first()
    assert r.snr_peak == pytest.approx(2 * math.sqrt(6))
    assert r.snr_area == pytest.approx(17 * math.sqrt(21) / 14)
    assert r.snr_mean == pytest.approx(2.8577380332470415)


REF = [(100.0, 5.0), (200.0, 15.0), (300.0, 2.0)]
CAND = [(101.0, 6.0), (198.0, 10.0), (201.0, 12.0), (400.0, 8.0)]


@pytest.mark.parametrize(
    "tolerance,cut,want",
    [
        (1.0, 0.0, (1 / 2, 2 / 3, 4 / 7, 1 / 2, 1 / 3)),
        (2.0, 0.0, (1 / 2, 2 / 3, 4 / 7, 1 / 2, 1 / 3)),
        (8.0, 0.0, (1 / 2, 2 / 3, 4 / 7, 1 / 2, 1 / 3)),
        (2.0, 4.0, (1 / 2, 1.0, 2 / 3, 1 / 2, 0.0)),
    ],
)
def test_peak_sets(spark, tolerance, cut, want):
    t = "array<struct<pos:double,prom:double>>"
    row = ([p for p in REF if p[1] >= cut], [p for p in CAND if p[1] >= cut])
    df = spark.createDataFrame([row], f"a {t}, b {t}")
    m = F.size(match_peaks(F.col("a"), F.col("b"), tolerance))
    r = df.select(ratios(F.size("a"), F.size("b"), m).alias("r")).first()["r"]
    assert tuple(r) == pytest.approx(want)


def test_empty_peak_sets(spark):
    r = spark.range(1).select(ratios(F.lit(0), F.lit(0), F.lit(0)).alias("r")).first()["r"]
    assert tuple(r) == (1.0, 1.0, 1.0, 0.0, 0.0)


def test_calibration(spark):
    rows = [(1, 0.0, 1.0, False), (1, 1.0, 3.0, False), (1, 2.0, 5.0, False)]
    blanks = [(1, None, 0.0, True), (1, None, 2.0, True)]
    df = spark.createDataFrame(rows + blanks, "k int, y_true double, y_pred double, is_blank boolean")
    r = tasks.detection_limits(df, ["k"]).first()
    assert (r.slope, r.intercept) == pytest.approx((2.0, 1.0))
    assert r.ich_lod == pytest.approx(3.3 * math.sqrt(2) / 2)
    assert r.ich_loq == pytest.approx(5 * math.sqrt(2))
    assert r.iupac_lod == pytest.approx(3 * math.sqrt(2) / 2)


OBS = "metric string, cluster_id string, perturbation_id string, alpha double, x double, y double"


def observations(spark):
    cells = [("p01", 0.1, 0, 0, 0), ("p01", 0.2, 1, 1, 1), ("p02", 0.1, 0, 2, 2), ("p02", 0.2, 1, 3, 3)]
    rows = []
    for c in ("c1", "c2"):
        for p, a, tied, perfect, y in cells:
            rows += [("tied", c, p, a, float(tied), float(y)), ("perfect", c, p, a, float(perfect), float(y))]
    return spark.createDataFrame(rows, OBS)


def test_alignment(spark):
    obs = observations(spark)
    nodes = L.fitted_nodes(obs, ["metric"])
    ag = {r.metric: r for r in L.alignment_gap(nodes, ["metric"]).collect()}
    assert (ag["tied"].sst, ag["tied"].sse_pooled, ag["tied"].sse_separate) == pytest.approx((10, 8, 0))
    assert ag["tied"].ag == pytest.approx(0.8)
    assert ag["perfect"].ag == 0.0
    parts = {(r.metric, r.cluster_id): r.ag_contribution for r in L.gap_contributions(nodes, ["metric"]).collect()}
    assert parts["tied", "c1"] == pytest.approx(0.4) and parts["tied", "c2"] == pytest.approx(0.4)
    fits = {(r.perturbation_id, r.alpha): r.fit_pooled for r in nodes.filter("metric = 'tied'").collect()}
    assert fits["p01", 0.1] == pytest.approx(1) and fits["p02", 0.2] == pytest.approx(2)
    oc = {r.metric: r.oc for r in L.concordance(L.concordance_cells(obs, ["metric"]), ["metric"]).collect()}
    assert oc == {"tied": pytest.approx(0.5), "perfect": pytest.approx(1.0)}
    stats = L.alignment_gap(nodes, ["metric"]).join(
        L.concordance(L.concordance_cells(obs, ["metric"]), ["metric"]), "metric"
    )
    c = {r.metric: r for r in L.compare(stats, [], "tied").collect()}["perfect"]
    assert (c.d_ag, c.d_oc) == pytest.approx((0.8, 0.5))
    weighted = {r.metric: r.ag for r in L.weighted_gap(obs.withColumn("w", F.lit(3)), ["metric"], "w").collect()}
    assert weighted["tied"] == pytest.approx(0.8) and weighted["perfect"] == 0.0


def test_pair_categories(spark):
    cells = [("p01", 0, 0), ("p01", 1, 1), ("p01", 2, 2), ("p02", 0, 0), ("p02", 1, 2), ("p02", 3, 1)]
    rows = [
        ("m", c, p, 0.1 * (k % 3 + 1), float(x), float(y)) for c in ("a", "b") for k, (p, x, y) in enumerate(cells)
    ]
    r = L.concordance(L.concordance_cells(spark.createDataFrame(rows, OBS), ["metric"]), ["metric"]).first()
    assert (r.agree, r.disagree, r.metric_tie, r.downstream_tie, r.double_tie) == (8, 2, 2, 4, 2)
    assert r.oc == pytest.approx(2 / 3)


def test_observation_checks(spark):
    obs = observations(spark)
    state = lambda df: {r.metric: r.state for r in L.check_observations(df, ["metric"]).collect()}
    assert state(obs) == {"tied": "complete", "perfect": "complete"}
    assert state(obs.unionByName(obs.filter("metric = 'tied'").limit(1)))["tied"] == "duplicate_condition"
    assert state(obs.filter("perturbation_id = 'p01'"))["tied"] == "too_few_perturbations"
    assert state(obs.filter("not (cluster_id = 'c1' and alpha = 0.1 and perturbation_id = 'p01')"))["tied"] == "incomplete_grid"


def test_constant_harm(spark):
    obs = observations(spark)
    flat = L.alignment_gap(L.fitted_nodes(obs.withColumn("y", F.lit(1.0)), ["metric"]), ["metric"])
    assert {(r.ag, r.state) for r in flat.collect()} == {(None, "constant_downstream")}
    same = L.alignment_gap(L.fitted_nodes(obs.withColumn("x", F.lit(1.0)), ["metric"]), ["metric"])
    assert {(r.ag, r.state) for r in same.collect()} == {(0.0, "constant_metric")}


def test_sign_flip(spark):
    df = spark.createDataFrame([("c1", 0.4, 0.5, 0.0), ("c2", 0.4, 0.5, 0.0)], "c string, a double, b double, z double")
    r = {x.contrast: x for x in I.sign_flip(df, "c", {"a": "sum", "b": "mean", "z": "sum"}, "t", 20000).collect()}
    assert r["a"].p_value == pytest.approx(0.5, abs=0.02)
    assert r["b"].p_value == r["a"].p_value
    assert r["z"].p_value == 1.0


def test_exact_sign_flip(spark):
    df = spark.createDataFrame([("m", s, 1.0) for s in range(5)], "m string, seed int, d double")
    r = I.sign_flip_exact(df, ["m"], "seed", "d").first()
    assert (r.n_patterns, r.n_extreme, r.p_value) == (32, 2, pytest.approx(2 / 32))


def test_holm(spark):
    rows = [("f", "h1", 0.01), ("f", "h2", 0.03), ("f", "h3", 0.04), ("g", "h", 0.05)]
    df = spark.createDataFrame(rows, "family string, hypothesis string, p_value double")
    r = {(x.family, x.hypothesis): (x.adjusted_p, x.rejected) for x in I.holm(df, ["family"]).collect()}
    assert r["f", "h1"] == (pytest.approx(0.03), True)
    assert r["f", "h2"] == (pytest.approx(0.06), False)
    assert r["f", "h3"] == (pytest.approx(0.06), False)
    assert r["g", "h"] == (pytest.approx(0.05), False)


def test_orient(spark):
    from signalharm.functions.measures import Measure

    rules = {
        "low": Measure("low", "lower", None),
        "high": Measure("high", "higher", None),
        "five": Measure("five", "target", None, 5.0),
        "odd": Measure("odd", "non_monotonic", None),
    }
    df = spark.createDataFrame(
        [("low", 2.0, 5.0), ("high", 2.0, 5.0), ("five", 3.0, 8.0), ("odd", 1.0, 2.0)], "o string, b double, c double"
    )
    got = {r.o: r.h for r in df.select("o", M.oriented(F.col("o"), F.col("b"), F.col("c"), rules).alias("h")).collect()}
    assert got == {"low": 3.0, "high": -3.0, "five": 1.0, "odd": None}


def test_harm_parts(spark):
    df = spark.createDataFrame([("k", -2.0), ("k", 0.0), ("k", 4.0)], "k string, y double")
    r = tasks.harm_parts(df, ["k"]).first()
    assert (r.signed_mean, r.positive_mean, r.negative_mean, r.absolute_mean) == pytest.approx((2 / 3, 4 / 3, 2 / 3, 2.0))


def test_class_tie_rule(spark):
    lib = [(i, c, [1.0, 0.0]) for i, c in enumerate((3, 1, 2))]
    library = spark.createDataFrame(lib, "lib_id long, class_id long, v array<double>").withColumn("k", F.lit(0))
    q = spark.createDataFrame([(7, 2, [1.0, 0.0])], "q long, true_class long, v array<double>").withColumn("k", F.lit(0))
    for tile in (1, 100):
        s = tasks.class_scores(q, library, ["k"], ["q", "true_class"], tile_rows=tile)
        r = tasks.topk(tasks.rank_classes(s, ["q"]), ["q"]).first()
        assert (r.predicted_class, r.true_rank, r.top1, r.topk) == (1, 2, False, True)


def test_transport_is_scale_free_and_translates(spark):
    x, y = [0, 1, 2, 3], [0, 2, 1, 0]
    assert pair(spark, "wasserstein_1", x, y, x, [5 * v for v in y]) == pytest.approx(0.0, abs=1e-12)
    assert pair(spark, "wasserstein_1", x, y, [v + 0.25 for v in x], y) == pytest.approx(0.25)
    assert pair(spark, "pearson", x, y, x, [3 * v + 7 for v in y]) == pytest.approx(1.0)


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0], [3.0, 1.0, 2.0, 5.0])], "x array<double>, y array<double>")
    r = df.select(
        A.node_widths("x").alias("w"),
        A.median("y").alias("m"),
        A.quantile(F.col("y"), 0.25).alias("q"),
        A.interpolate_at(F.col("x"), F.col("y"), F.lit(3.0)).alias("i"),
        A.interpolate_at(F.col("x"), F.col("y"), F.lit(8.0)).alias("e"),
        A.interpolate_at(F.col("x"), F.col("y"), F.lit(9.0)).alias("o"),
    ).first()
    assert r.w == [0.5, 1.5, 3.0, 2.0]
    assert (r.m, r.q, r.i, r.e, r.o) == (2.5, 1.75, 1.5, 5.0, None)
