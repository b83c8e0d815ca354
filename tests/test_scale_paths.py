"""The paths that split hot groups give the same answers as brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from signalharm.operators import audit, isotonic, models, quantiles, ranks, splits
from signalharm.operators.checkpoints import ensure_checkpoint_dir


def brute_isotonic(x, y, w):
    g = pd.DataFrame({"x": x, "wy": w * y, "w": w}).groupby("x").sum().sort_index()
    m, sw = (g.wy / g.w).to_numpy(), g.w.to_numpy()
    cs, cw = np.concatenate([[0], np.cumsum(m * sw)]), np.concatenate([[0], np.cumsum(sw)])
    n = len(m)
    fit = [max(min((cs[k + 1] - cs[j]) / (cw[k + 1] - cw[j]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
    return dict(zip(g.index, fit))


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = np.round(rng.uniform(0, 10, n), 1)
    pdf = pd.DataFrame(
        {"k": np.where(np.arange(n) % 4 == 0, "small", "hot"), "x": x, "y": x + rng.normal(0, 3, n), "w": rng.integers(1, 4, n).astype(float)}
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_isotonic_paths(curve, limit):
    pdf, df = curve
    got = isotonic.isotonic_fit(df, ["k"], "x", "y", "w", limit=limit).toPandas()
    assert len(got) == len(pdf)
    for k, part in pdf.groupby("k"):
        want = brute_isotonic(part.x.to_numpy(), part.y.to_numpy(), part.w.to_numpy())
        g = got[got.k == k]
        assert np.allclose(g.fit, [want[v] for v in g.x], atol=1e-9)


def test_isotonic_monotone_hot_key(spark):
    """Nothing pools, so the pools never fit the limit and the loop must still end."""
    df = spark.range(300).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("x"), (2.0 * F.col("id")).alias("y"))
    got = isotonic.isotonic_fit(df, ["k"], "x", "y", limit=50).toPandas()
    assert np.allclose(got.fit, got.y) and len(got) == 300


@pytest.mark.parametrize("limit", [5, 50, isotonic.LIMIT])
def test_isotonic_mixed_sizes(spark, limit):
    """A key above the limit does not change how the others are fitted, however few points they have."""
    rng = np.random.default_rng(7)
    parts = [
        pd.DataFrame({"k": "rising", "x": np.arange(200.0), "y": 2.0 * np.arange(200)}),
        pd.DataFrame({"k": "noisy", "x": np.arange(150.0), "y": np.arange(150) + rng.normal(0, 30, 150)}),
        pd.DataFrame({"k": "falling", "x": np.arange(60.0), "y": -np.arange(60.0)}),
        pd.DataFrame({"k": "small", "x": [1.0, 2.0, 3.0], "y": [3.0, 2.0, 1.0]}),
        pd.DataFrame({"k": "one", "x": [5.0], "y": [1.0]}),
        pd.DataFrame({"k": None, "x": [1.0, 2.0], "y": [2.0, 1.0]}),
    ]
    pdf = pd.concat(parts, ignore_index=True)
    pts = isotonic.points(spark.createDataFrame(pdf, "k string, x double, y double"), ["k"], "x", "y")
    got = isotonic.fit_points(pts, ["k"], limit).toPandas()
    assert len(got) == len(pdf)
    for part in parts:
        k = part.k.iloc[0]
        g = got[got.k.isna() if k is None else got.k == k]
        want = brute_isotonic(part.x.to_numpy(), part.y.to_numpy(), np.ones(len(part)))
        assert np.allclose(g.fit, [want[v] for v in g.x_lo], atol=1e-9)


def test_isotonic_agrees_with_mllib(spark):
    rows = [(0.0, 0.0), (1.0, 1.0), (0.0, 2.0), (1.0, 3.0)]
    df = spark.createDataFrame(rows, "x double, y double").withColumn("k", F.lit(1))
    got = {r.x: r.fit for r in isotonic.isotonic_fit(df, ["k"], "x", "y").collect()}
    model = IsotonicRegression(featuresCol="x", labelCol="y").fit(df)
    assert got == {0.0: 1.0, 1.0: 2.0}
    assert list(model.predictions) == [1.0, 2.0]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.zeros(500), rng.lognormal(0, 3, 900)])
    pdf = pd.DataFrame({"k": np.where(np.arange(len(v)) % 3 == 0, "a", "b"), "v": v})
    got = quantiles.exact_quantiles(
        spark.createDataFrame(pdf), ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.975}, bins=16
    ).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        assert np.allclose(got.loc[k, ["lo", "mid", "hi"]].astype(float), np.quantile(part.v, [0.05, 0.5, 0.975]))


def test_ordered_rank_and_hash_rank(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("o"))
    r = ranks.ordered_rank(df, ["k"], "o").toPandas()
    for _, part in r.groupby("k"):
        p = part.sort_values("o")
        assert list(p["rank"]) == list(range(1, len(p) + 1))
    h = splits.hash_rank(df, ["k"], "o", "s").toPandas()
    for _, part in h.groupby("k"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_components_chain_and_hub(spark):
    ensure_checkpoint_dir(spark)
    chain = [(i, f"c{i}") for i in range(40)] + [(i + 1, f"c{i}") for i in range(40)]
    hub = [(i, "hub") for i in range(100, 200)]
    df = spark.createDataFrame(chain + hub + [(500, "alone")], "id long, hub string")
    got = {r.id: r.component_id for r in splits.leakage_components(df, "id", "hub").collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[i] for i in range(100, 200)} == {100}
    assert got[500] == 500


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (40, 32))
    moved = base[:15] + rng.normal(0, 8e-4, (15, 32))
    y = np.vstack([base, moved, base[:6], base[:2]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "signal_id long, y array<double>")
    got = audit.near_duplicates(df, threshold=1e-3).toPandas()
    v = (y - y.mean(1, keepdims=True)) / y.std(1, keepdims=True)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).mean(2))
    i, j = np.triu_indices(len(y), 1)
    assert got.n_pairs.sum() == int((d[i, j] <= 1e-3).sum())


def test_near_duplicate_groups(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (30, 32))
    chain = base[0] + np.arange(6)[:, None] * 7e-4 * np.sign(rng.normal(size=32))  # neighbours are near, ends are not
    y = np.vstack([base, chain, np.repeat(base[1:2], 40, 0), base[2:9] + rng.normal(0, 3e-4, (7, 32))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(y)] + [(900, [2.0] * 32), (901, [2.0] * 32), (902, [float("nan")] * 32), (903, None), (904, [])]
    df = spark.createDataFrame(rows, "signal_id long, y array<double>")
    v = (y - y.mean(1, keepdims=True)) / y.std(1, keepdims=True)
    near = np.sqrt(((v[:, None] - v[None]) ** 2).mean(2)) <= 1e-3
    label = np.arange(len(y))
    for _ in y:
        label = np.array([label[near[i]].min() for i in range(len(y))])
    want = {}
    for c in set(label):
        at = np.flatnonzero(label == c)
        if len(at) > 1:
            want[c] = (len(at), int(np.triu(near[np.ix_(at, at)], 1).sum()))
    got = {r.component: (r.n_signals, r.n_links) for r in audit.near_duplicate_groups(df).collect()}
    assert got == want
    states = {r.signal_id: r.state for r in audit.signal_states(df).collect() if r.signal_id >= 900}
    assert states == {900: "constant", 901: "constant", 902: "not_finite", 903: "empty", 904: "empty"}
    reps = df.filter("signal_id < 900").selectExpr("signal_id AS rep", "size(y) AS n", "y AS v")
    assert audit._near_cells(reps, 1e-3, 4).columns == ["rep", "n", "c"]  # no vector meets the exchange
    assert audit.near_candidates(reps, 1e-3).columns == ["left_id", "right_id"]
    assert audit.near_duplicate_groups(df.limit(0)).count() == 0


def test_calibration_pairs(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(60)], "id long, entity long")
    p = splits.calibration_pairs(df, "id", "entity", 50, 3).toPandas()
    assert len(p.drop_duplicates()) == 50 and (p.left_id % 4 != p.right_id % 4).all() and (p.left_id < p.right_id).all()
    nearly_all = splits.calibration_pairs(df, "id", "entity", 1340, 3)  # of 1,350
    assert nearly_all.distinct().count() == 1340
    few = splits.calibration_pairs(df.limit(4), "id", "entity", 50, 3)
    assert few.count() == 6


def test_pls_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6))
    y = x[:, :2] @ np.array([[1.0, 2.0], [0.5, -1.0]]) + 0.1 * rng.normal(size=(80, 2))
    df = spark.createDataFrame([([float(v) for v in a], [float(v) for v in b]) for a, b in zip(x, y)], "x array<double>, y array<double>")
    n, gram = models.moments(df, "x", "y")
    assert n == 80
    b, a = models.pls_coefficients(gram, 6, [6])[6]
    design = np.column_stack([np.ones(80), x])
    ols = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(b, ols[1:], atol=1e-8) and np.allclose(a, ols[0], atol=1e-8)
    one_b, _ = models.pls_coefficients(gram, 6, [1])[1]
    xs, ys = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean(0)) / y.std(0, ddof=1)
    w = np.linalg.svd(xs.T @ ys)[0][:, 0]
    t = xs @ w
    want = np.outer(w, ys.T @ t / (t @ t)) * y.std(0, ddof=1) / x.std(0, ddof=1)[:, None]
    assert np.allclose(one_b, want)


def _bad_rows(spark):
    """Signals of 0 to 3 points, constant, with a repeated node, beside good ones."""
    rng = np.random.default_rng(5)
    good = [(i, [float(k) for k in range(16)], rng.normal(size=16).tolist()) for i in range(6)]
    bad = [(100 + n, [float(k) for k in range(n)], [float(k * k) for k in range(n)]) for n in range(4)]
    bad += [(110, [0.0, 1.0, 2.0, 3.0, 4.0], [2.0] * 5), (111, [0.0, 1.0, 1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 0.0])]
    return spark.createDataFrame(good + bad, "signal_id long, axis array<double>, y array<double>"), {g[0] for g in good}


def test_bad_signals_have_states(spark):
    from signalharm.functions.measures import MEASURES, Pair

    df, good = _bad_rows(spark)
    pair = Pair(F.col("axis"), F.col("y"), F.col("axis"), F.col("y"))
    names = [n for n in ("mse", "rmse", "mae", "nmse", "pearson") if n in MEASURES]
    got = {r.signal_id: r for r in df.select("signal_id", *[MEASURES[n].expression(pair).cast("double").alias(n) for n in names]).collect()}
    assert all(got[i].mse == 0 for i in good) and got[100].mse is None and got[100].rmse is None
    copies = df.union(df.filter("signal_id < 2").withColumn("signal_id", F.col("signal_id") + 50))
    pairs = {(r.left_id, r.right_id) for r in audit.near_duplicates(copies).collect()}
    assert {(0, 0), (1, 1)} <= pairs


def test_snr_states(spark):
    from signalharm.operators.measure import snr

    x = [float(k) for k in range(20)]
    y = [float((k * 7) % 5) for k in range(20)]
    region = lambda role, lo, hi: (role, float(lo), float(hi))
    rows = [
        (1, x, y, [region("signal", 0, 4), region("noise", 8, 12), region("reference", 14, 18)]),
        (2, x, y, [region("signal", 0, 8), region("noise", 8, 12), region("reference", 14, 18)]),
        (3, x, y, [region("signal", 0, 4), region("noise", 30, 40), region("reference", 4, 6)]),
        (4, x, y, [region("signal", 50, 60), region("noise", 8, 12), region("reference", 14, 18)]),
    ]
    schema = "signal_id long, axis array<double>, y array<double>, regions array<struct<role string, lo double, hi double>>"
    got = {r.signal_id: (r.snr_peak, r.snr_area, r.snr_mean) for r in snr(spark.createDataFrame(rows, schema)).collect()}
    assert None not in got[1]
    assert got[2][:2] == (None, None) and got[2][2] is not None  # the noise touches the signal
    assert got[3] == (None, None, None)  # no noise nodes; the reference touches
    assert got[4][:2] == (None, None)


def test_false_peaks_above_the_default_grid(spark):
    from signalharm.operators.perturb import perturb

    x = [float(k) for k in range(400)]
    y = [float(np.exp(-0.5 * ((k - 100) / 2) ** 2) + np.exp(-0.5 * ((k - 150) / 2) ** 2) + np.exp(-0.5 * ((k - 200) / 2) ** 2) + 0.5 * np.exp(-0.5 * ((k - 300) / 2) ** 2)) for k in range(400)]
    df = spark.createDataFrame([(1, x, y)], "signal_id long, axis array<double>, y array<double>")
    got = {r.alpha: sum(r.y) - sum(r.ref_y) for r in perturb(df, ("p05",), (0.5, 0.8, 1.0), identity=False).collect()}
    assert got[1.0] > 1.2 * got[0.8] > 1.2 * got[0.5] > 0


def test_settled_harms_do_not_depend_on_the_unit(spark):
    from signalharm.operators.measure import settled

    rows = [("a", 0.1 + 0.2, 1), ("a", 0.3, 2), ("a", 0.4, 3), ("b", 0.0, 4), (None, 2.0, 5)]
    df = spark.createDataFrame(rows, "metric string, x double, i int")
    for scale in (1.0, 1e-12, 1e12):
        got = {r.i: r.x / scale for r in settled(df.withColumn("x", F.col("x") * scale), ["metric"]).collect()}
        assert got[1] == got[2] and got[3] > got[2] and got[4] == 0 and abs(got[5] - 2) < 1e-9


def test_register_perturbation(spark):
    from signalharm.operators import perturb as P

    P.register_perturbation("x01", lambda a: F.transform("ref_y", lambda v: v * (1 - a)))
    try:
        df = spark.createDataFrame([(1, [0.0, 1.0], [2.0, 4.0])], "signal_id long, axis array<double>, y array<double>")
        got = {(r.perturbation_id, r.alpha): r.y for r in P.perturb(df, ("x01",), (0.5,)).collect()}
        assert got["x01", 0.5] == [1.0, 2.0]
        with pytest.raises(ValueError):
            P.perturb(df, ("x02",))
    finally:
        P.CUSTOM.pop("x01")


def test_exact_sign_flip_refuses_many_units(spark):
    from signalharm.operators import infer

    df = spark.range(40).select(F.lit("k").alias("k"), F.col("id").alias("u"), F.lit(1.0).alias("v"))
    with pytest.raises(Exception, match="too many units"):
        infer.sign_flip_exact(df, ["k"], "u", "v").collect()


def test_cells_spread_skewed_values(spark):
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.exp(F.col("id") / 2000.0).alias("v"))
    df = df.union(spark.createDataFrame([("k", 1e12), (None, 1.0), (None, 2.0)], "k string, v double"))
    sizes = quantiles.with_cells(df, ["k"], "v", 64).groupBy("k", "_cell").count().toPandas()
    assert sizes["count"].sum() == 20_003 and sizes["count"].max() < 3 * 20_000 / 64
    got = quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5, "top": 1.0}).filter("k = 'k'").first()
    assert got.top == 1e12 and abs(got.m - np.exp(10_000 / 2000.0)) < 1e-9


def test_both_protocols_share_the_mean_harms(spark, sf, monkeypatch):
    from signalharm.plans import observations as O

    formed, form = [], O.metric_harm
    monkeypatch.setattr(O, "_CACHE", {})
    monkeypatch.setattr(O, "metric_harm", lambda *a, **k: formed.append(a) or form(*a, **k))
    fixed, adapted = O.observations(spark, sf), O.observations(spark, sf, adapted=True)
    assert len(formed) == 1
    assert fixed.columns == adapted.columns
    O.harms(spark, sf, O.OUTPUTS[:2])
    assert len(formed) == 2, "other outputs are other harms"
    for df in O._CACHE.values():
        df.unpersist()
