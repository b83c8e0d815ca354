"""Cells in blocks against the column expressions, with odd signals among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalharm.functions import peak_counts
from signalharm.operators import blocks as B
from signalharm.operators import tasks
from signalharm.plans import observations as O
from signalharm.plans import q_align, q_models


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(24):
        n = 64 if i % 3 else 70
        axis = [float(v) for v in (np.arange(1, n + 1) if i % 4 else np.arange(1, n + 1) * 1.01 + 0.3)]
        y = rng.normal(size=n).round(6).tolist()
        if i == 7:
            y = [0.0] * n
        if i == 8:
            y[0] = None
        if i == 9:
            y[40] = float("nan")
        if i == 10:
            y = [2.0] * n
        rows.append((i, i % 3, f"g{i % 6}", axis, y))
    return spark.createDataFrame(rows, "signal_id long, class_id long, group_id string, axis array<double>, y array<double>").cache()


def test_mean_values_equal_expressions(odd):
    keys = ["metric", "cluster_id", "perturbation_id", "alpha"]
    own = odd.filter("signal_id <> 9")  # a nan mean equals nothing
    want = B.expressed(own, "class_id", O.OUTPUTS, B.FAMILIES).groupBy(*keys).agg(F.avg("h").alias("x"))
    a = {tuple(r)[:4]: r.x for r in want.collect()}
    b = {tuple(r)[:4]: r.x for r in B.mean_values(own, "class_id", O.OUTPUTS).select(*keys, "x").collect()}
    assert a.keys() == b.keys() and len(a) == 6 * 3 * 40
    assert all((a[k] is None) == (b[k] is None) for k in a)
    assert max(abs(a[k] - b[k]) / (1 + abs(a[k])) for k in a if a[k] is not None) < 1e-9


def test_all_outputs_equal_expressions(odd):
    keys = ["metric", "cluster_id", "perturbation_id", "alpha"]
    own = odd.filter("signal_id <> 9")
    assert B.covers(O.ALL_OUTPUTS, B.FAMILIES)
    want = B.expressed(own, "class_id", O.ALL_OUTPUTS, B.FAMILIES).groupBy(*keys).agg(F.avg("h").alias("x"))
    a = {tuple(r)[:4]: r.x for r in want.collect()}
    b = {tuple(r)[:4]: r.x for r in B.mean_values(own, "class_id", O.ALL_OUTPUTS).select(*keys, "x").collect()}
    assert a.keys() == b.keys() and len(a) == 13 * 3 * 40
    assert all((a[k] is None) == (b[k] is None) for k in a)
    assert max(abs(a[k] - b[k]) / (1 + abs(a[k])) for k in a if a[k] is not None) < 1e-9


def test_observations_cover_the_study_s_outputs(spark, sf):
    rows = q_align.observations(spark, sf).groupBy("metric").count().collect()
    assert {r.metric for r in rows} == set(O.ALL_OUTPUTS) and len({r["count"] for r in rows}) == 1


@pytest.mark.parametrize("n", [2, 3, 4, 64, 129])
def test_peaks_of_matrices_equal_those_of_rows(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.choice([0.5, 1.0, 1.3], n))
    moved = x + 1.7 * np.linspace(0, 1, n)
    y = rng.normal(size=(60, n)).round(1)
    z = y + rng.normal(size=y.shape).round(1) / 2
    y[0], z[1] = 2.0, np.arange(n)
    a, b = peak_counts.peak_mask(y), peak_counts.peak_mask(z)
    hits = peak_counts.match_rows(x, a, moved, b, 2.0)
    for r in range(len(y)):
        p, q = peak_counts.peak_positions(x, y[r]), peak_counts.peak_positions(moved, z[r])
        assert x[a[r]].tolist() == p and moved[b[r]].tolist() == q
        assert hits[r] == peak_counts.matches(p, q, 2.0)


@pytest.mark.parametrize("adapted", [False, True])
def test_library_in_blocks_equals_tiles(odd, adapted):
    seeds = F.array(*[F.when(F.col("group_id") != f"g{s}", F.lit(s)) for s in (1, 2)])
    members = odd.withColumn("seeds", F.array_compact(seeds))
    vectors = O.by_expressions(odd, B.FAMILIES)
    q = vectors.filter("group_id in ('g1', 'g2')").withColumn("seed", F.substring("group_id", 2, 1).cast("int")).withColumnRenamed("class_id", "true_class")
    key = ["seed", "signal_id", "true_class", "perturbation_id", "alpha"]
    fine = B.sound(O.GRID)
    lib = members.filter(fine)
    ready = O.by_expressions(members.filter(~fine), B.FAMILIES)
    got = B.moved_library_scores(q.select(*key, "v"), B.with_state(lib) if adapted else lib, ready, B.FAMILIES, O.GRID, adapted, (24, 400), 12)
    source = O.by_expressions(members, B.FAMILIES) if adapted else O.by_expressions(members, ())
    source = source.withColumn("seed", F.explode("seeds")).withColumnRenamed("signal_id", "lib_id")
    on = ["seed", "perturbation_id", "alpha"] if adapted else ["seed"]
    want = tasks.class_scores(q.select(*key, "v"), source, on, [k for k in key if k not in on], sizes=(24, 400))
    cols = [*key, "class_id", "score"]
    a, b = ({tuple(r)[:6]: r.score for r in d.select(*cols).collect()} for d in (want, got))
    assert a.keys() == b.keys() and a
    assert max(abs(a[k] - b[k]) for k in a) < 1e-10
    formed = B.grid_vectors(odd, B.FAMILIES, O.GRID, lambda d: O.by_expressions(d, B.FAMILIES))
    assert formed.count() == vectors.count()


def test_normalised_errors_equal_expressions(spark, odd):
    keys = ["variant", "metric", "cluster_id", "perturbation_id", "alpha"]
    own = odd.filter("signal_id <> 9")  # a nan mean equals nothing
    by_row = lambda d: q_models.normalised_errors(spark, None, d)
    a = {tuple(r)[:5]: r.x for r in by_row(own).groupBy(*keys).agg(F.avg("h").alias("x")).select(*keys, "x").collect()}
    got = B.mean_values(own, "class_id", ("mse", "mae"), B.FAMILIES, O.GRID, False, by_row, q_models._NORMS)
    b = {tuple(r)[:5]: r.x for r in got.select(*keys, "x").collect()}
    assert a.keys() == b.keys() and len(a) == 4 * 2 * 3 * 40
    assert all((a[k] is None) == (b[k] is None) for k in a)
    assert max(abs(a[k] - b[k]) / (1 + abs(a[k])) for k in a if a[k] is not None) < 1e-9


def test_sensitivity_interprets_no_sound_signal(spark, sf, monkeypatch):
    formed, form = [], B.mean_values
    monkeypatch.setattr(B, "mean_values", lambda *a, **k: formed.append(form(*a, **k)) or formed[-1])
    assert q_models.sensitivity(spark, sf).count() == 8
    plan = formed[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
