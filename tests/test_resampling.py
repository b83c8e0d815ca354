"""Blocks of draws and flips, and contrasts formed inside draws, against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalharm.operators import align, contrasts, infer, resample


def increasing_fit(x, y, w):
    """Pool adjacent violators, one point at a time."""
    pools = []
    for v in sorted(set(x)):
        at = [i for i in range(len(x)) if x[i] == v and w[i] > 0]
        if at:
            pools.append([sum(w[i] for i in at), sum(w[i] * y[i] for i in at), {v}])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                b, a = pools.pop(), pools.pop()
                pools.append([a[0] + b[0], a[1] + b[1], a[2] | b[2]])
    return {v: t / n for n, t, vs in pools for v in vs}


def naive_gap(rows, weights):
    w = [weights.get(r[0], 0) for r in rows]
    x, y = [r[3] for r in rows], [r[4] for r in rows]
    n = sum(w)
    mean = sum(a * b for a, b in zip(w, y)) / n
    sst = sum(a * (b - mean) ** 2 for a, b in zip(w, y))
    if sst <= 1e-12:
        return None
    if len({v for v, a in zip(x, w) if a > 0}) < 2:
        return 0.0

    def sse(at):
        fit = increasing_fit([x[i] for i in at], [y[i] for i in at], [w[i] for i in at])
        return sum(w[i] * (y[i] - fit[x[i]]) ** 2 for i in at if w[i] > 0)

    families = sorted({r[1] for r in rows})
    return (sse(range(len(rows))) - sum(sse([i for i, r in enumerate(rows) if r[1] == p]) for p in families)) / sst


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows = []
    for metric in ("mse", "other", "still"):
        for c in range(6):
            for p in ("p08", "p09"):
                for a in (0.1, 0.2, 0.4):
                    x = 0.0 if metric == "still" else float(np.round(rng.random(), 1))
                    # one cluster has no outcome variation: a draw of it alone fails
                    rows.append((metric, c, p, a, x, float(np.round(rng.normal() if c else 0.5, 2))))
    obs = spark.createDataFrame(rows, "metric string, cluster_id long, perturbation_id string, alpha double, x double, y double").persist()
    keys = ["metric"]
    oc = align.cluster_concordance(align.concordance_cells(obs, keys), keys).select("metric", "cluster_id", "oc").persist()
    return rows, obs, oc


def test_draw_statistics(spark, panel, monkeypatch):
    rows, obs, oc = panel
    monkeypatch.setattr(resample, "DRAW_BLOCK", 7)
    monkeypatch.setattr(resample, "CELLS", 100)
    draws = infer.draw_table(obs, "cluster_id", "t", 30)
    got = {(r.metric, r.resample): r for r in infer.draw_statistics(obs, oc, draws, ["metric"]).collect()}
    assert len(got) == 3 * 30
    weights, score = {}, {(r.metric, r.cluster_id): r.oc for r in oc.collect()}
    for r in draws.collect():
        weights.setdefault(r.resample, {})[r.cluster_id] = r.weight
    for (metric, k), r in got.items():
        own = [(x[1], x[2], x[3], x[4], x[5]) for x in rows if x[0] == metric]
        want = naive_gap(own, weights[k])
        assert (want is None and r.ag is None) or r.ag == pytest.approx(want, abs=1e-9)
        n = sum(weights[k].values())
        assert r.oc == pytest.approx(sum(score[metric, c] * w for c, w in weights[k].items()) / n)
    # a key beyond one task goes the distributed way and agrees
    monkeypatch.setattr(infer, "MAX_KEY_ROWS", 10)
    for r in infer.draw_statistics(obs, oc, draws, ["metric"]).collect():
        other = got[r.metric, r.resample]
        assert (r.ag is None and other.ag is None) or r.ag == pytest.approx(other.ag, abs=1e-9)
        assert r.oc == pytest.approx(other.oc)


def test_draws_do_not_multiply_rows(spark, panel):
    """Observations are copied once a block of draws, draws once a bucket: nothing is as large as their product."""
    _, obs, oc = panel
    plan = infer.draw_statistics(obs, oc, infer.draw_table(obs, "cluster_id", "t", 1000), ["metric"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in text
    # the only join with draws is their own: counted draws to cluster ids
    assert "weight" not in "".join(line for line in text.splitlines() if "Join" in line and "perturbation_id" in line)


def sign(seed, flip, cluster):
    digest = hashlib.md5(f"{seed}|{flip // 128}|{cluster}".encode()).hexdigest()
    return -1.0 if int(digest[flip % 128 // 4], 16) >> (flip % 4) & 1 else 1.0


def test_sign_flip_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "FLIP_RANGE", 256)
    monkeypatch.setattr(resample, "CLUSTER_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b) if i != 4 else None) for i, (a, b) in enumerate(rng.normal(size=(11, 2)))]
    df = spark.createDataFrame(rows, "c long, a double, b double").repartition(4)
    flips = 1000
    got = {r.contrast: r for r in infer.sign_flip(df, "c", {"a": "sum", "b": "mean"}, "t", flips).collect()}
    seed = infer.endpoint_seed("t", "sign_flip")
    for k, (name, n) in enumerate((("a", 1), ("b", 10)), 1):
        own = [(r[0], r[k]) for r in rows if r[k] is not None]
        observed = sum(v for _, v in own) / n
        extreme = sum(abs(sum(sign(seed, f, c) * v for c, v in own)) / n + 1e-15 >= abs(observed) for f in range(flips))
        assert got[name].observed == pytest.approx(observed)
        assert got[name].n_extreme == extreme and got[name].p_value == pytest.approx((extreme + 1) / (flips + 1))


def test_signs_are_fair():
    s = resample.sign_bits("x", list(range(50)), 128, 1280)
    assert s.shape == (50, 1280) and set(np.unique(s)) == {-1, 1} and abs(s.mean()) < 0.02
    assert abs(np.corrcoef(s.astype(float))[0, 1:]).max() < 0.15


def test_sign_flip_rmse(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(n), *map(float, e)) for i, (n, e) in enumerate(zip(rng.integers(3, 9, 8), rng.random((8, 4)) * 5))]
    df = spark.createDataFrame(rows, "c long, n long, l0 double, l1 double, r0 double, r1 double")
    got = infer.sign_flip_rmse(df, "c", ["l0", "l1"], ["r0", "r1"], [2.0, 3.0], "t", 512).first()
    seed, n = infer.endpoint_seed("t", "sign_flip"), sum(r[1] for r in rows)

    def effect(signs):
        swapped = [(r[2:4], r[4:6]) if s > 0 else (r[4:6], r[2:4]) for r, s in zip(rows, signs)]
        error = lambda side: sum(math.sqrt(sum(x[side][t] for x in swapped) / n) / d for t, d in ((0, 2.0), (1, 3.0))) / 2
        return 100 * (error(0) - error(1))

    observed = effect([1] * 8)
    assert got.observed == pytest.approx(observed)
    assert got.n_extreme == sum(abs(effect([sign(seed, f, c) for c in range(8)])) + 1e-12 >= abs(observed) for f in range(512))


def test_contrasts_inside_draws(spark):
    """A difference of panels is taken draw by draw; one draw without a value leaves no interval."""
    rows = [(k, p, float(v)) for k in range(40) for p, v in (("a", k), ("b", 2 * k + (k % 3)))]
    drawn = spark.createDataFrame([(k, p, v, None if k == 5 else v) for k, p, v in rows], "resample int, panel string, ag double, oc double")
    point = spark.createDataFrame([("a", 10.0, 1.0), ("b", 25.0, 2.0)], "panel string, ag double, oc double")
    endpoints = {f"{c}_{p}": ({"panel": p}, c) for c in ("ag", "oc") for p in "ab"}
    got = contrasts.contrast_intervals(
        point, drawn, [], endpoints, {"d": F.col("ag_b") - F.col("ag_a"), "e": F.col("oc_b") - F.col("oc_a"), "ratio": F.col("ag_a") / (F.col("ag_b") + 1)}
    ).first()
    d = [k + k % 3 for k in range(40)]
    assert got.d == 15.0 and got.d_lower == pytest.approx(np.quantile(d, 0.025)) and got.d_upper == pytest.approx(np.quantile(d, 0.975))
    assert got.e == 1.0 and got.e_lower is None and got.e_upper is None
    assert got.ratio == pytest.approx(10 / 26)


def test_shares_inside_draws(spark):
    rng = np.random.default_rng(6)
    rows = [(c, p, float(v)) for c in range(5) for p in ("p08", "p11", "p12") for v in rng.normal(size=3)]
    df = spark.createDataFrame(rows, "cluster_id long, family string, y double").withColumn("panel", F.lit("x"))
    draws = infer.draw_table(df, "cluster_id", "t", 50)
    got = {r.component: r for r in contrasts.shares(df, "cluster_id", ["panel"], "family", {"axis": ("p11", "p12")}, draws).collect()}
    weights = {}
    for r in draws.collect():
        weights.setdefault(r.resample, {})[r.cluster_id] = r.weight

    def share(members, part, w):
        sums = {p: sum(w.get(c, 0) * part(v) for c, q, v in rows if q == p) for p in ("p08", "p11", "p12")}
        return sum(sums[p] for p in members) / sum(sums.values())

    for component, members in (("p08", ("p08",)), ("p11", ("p11",)), ("axis", ("p11", "p12"))):
        for name, part in (("positive", lambda v: max(v, 0.0)), ("absolute", abs)):
            assert got[component][f"{name}_share"] == pytest.approx(share(members, part, {c: 1 for c in range(5)}))
            each = [share(members, part, w) for w in weights.values()]
            assert got[component][f"{name}_share_lower"] == pytest.approx(np.quantile(each, 0.025))
            assert got[component][f"{name}_share_upper"] == pytest.approx(np.quantile(each, 0.975))
    nothing = contrasts.shares(df.withColumn("y", F.lit(-1.0)), "cluster_id", ["panel"], "family", {}, draws).first()
    assert nothing.positive_state == "undefined" and nothing.absolute_state == "complete" and nothing.positive_share is None
