"""Registered queries against their DuckDB statements, and the whole workflow."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tools.check import TABLES, compare

# one query per family; tools/check.py runs them all
KEYS = (
    "measure_w1 measure_stn peak_scans resample_pchip savgol baseline_snip perturb_p03 perturb_p10 leakage_components "
    "few_shot round_robin_sample calibration_pairs observations alignment_gap oc_by_pair bootstrap_mean sign_flip_rmse "
    "class_report near_dups validate_signals endmembers shrunk_cov ingest_text_signals method_effects"
).split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, duck, sf, key):
    assert compare(spark, duck, key, entry.queries()[key], entry.oracle_sql()[key], sf)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_pca_against_numpy(spark, sf):
    import numpy as np

    from signalharm.operators.signals import pca_reconstruct
    from signalharm.plans.tables import signals

    df = signals(spark, sf)
    got = pca_reconstruct(df, df, 5).select("signal_id", "y", "reconstructed").toPandas()
    y = np.stack(got.y)
    m = y.mean(0)
    v = np.linalg.svd(y - m, full_matrices=False)[2][:5]
    assert np.allclose(np.stack(got.reconstructed), (y - m) @ v.T @ v + m, atol=1e-6)


def _greedy(a, b, tol):
    pairs = sorted((abs(q - p), i, j) for i, p in enumerate(a) for j, q in enumerate(b) if abs(q - p) <= tol)
    left, right, out = set(), set(), []
    for _, i, j in pairs:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return out


def _expected(r):
    import math

    base, cand = [p.pos for p in r.baseline], [p.pos for p in r.candidate]
    m = _greedy(base, cand, 2.0)
    share = lambda a, b: a / b if b else None
    if r.perturbation_id == "p01":
        return {"p01_retention": share(len(m), len(base))}
    if r.perturbation_id == "p02":
        hit = {i for i, p in enumerate(base) if any(s.lo <= p <= s.hi for s in r.supports)}
        kept = {i for i, _ in m}
        rest = set(range(len(base))) - hit
        return {
            "p02_affected_retention": share(len(hit & kept), len(hit)),
            "p02_unaffected_retention": share(len(rest & kept), len(rest)),
        }
    if r.perturbation_id == "p03":
        return {
            "p03_retention": share(len(m), len(base)),
            "p03_position_mae": share(sum(abs(cand[j] - base[i]) for i, j in m), len(m)),
            "p03_log2_fwhm_ratio": share(sum(math.log2(r.candidate[j].fwhm / r.baseline[i].fwhm) for i, j in m), len(m)),
        }
    events = sorted(r.events)
    eb = _greedy(events, base, 2.0)
    gone = {j for _, j in eb}
    rest_base = [p for i, p in enumerate(base) if i not in gone]
    if r.perturbation_id == "p04":
        eligible = [events[i] for i, _ in sorted(eb)]
        el = _greedy(eligible, cand, 2.0)
        rest_cand = [p for j, p in enumerate(cand) if j not in {k for _, k in el}]
        return {
            "p04_disappearance": share(len(eb) - len(el), len(eb)),
            "p04_undeleted_retention": share(len(_greedy(rest_base, rest_cand, 2.0)), len(rest_base)),
        }
    ec = _greedy(events, cand, 2.0)
    if not events:
        return {"p05_detection_gain": None, "p05_native_retention": None}
    rest_cand = [p for j, p in enumerate(cand) if j not in {k for _, k in ec}]
    return {
        "p05_detection_gain": (len(ec) - len(eb)) / len(events),
        "p05_native_retention": share(len(_greedy(rest_base, rest_cand, 2.0)), len(rest_base)),
    }


def test_mechanism_against_brute_force(spark, sf):
    from signalharm.operators.mechanism import endpoints
    from signalharm.plans.q_models import mechanism_cells

    cells = mechanism_cells(spark, sf, (0.3, 0.65)).filter("signal_id < 40").persist()
    got = {
        (r.signal_id, r.perturbation_id, r.alpha, r.endpoint_id): r.value for r in endpoints(cells).collect()
    }
    want = {}
    for r in cells.collect():
        for k, v in _expected(r).items():
            want[r.signal_id, r.perturbation_id, r.alpha, k] = v
    assert got.keys() == want.keys() and len(got) > 300
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v)), k


def test_evaluate_with_a_registered_measure(spark, sf):
    from signalharm.functions.measures import MEASURES, register_measure
    from signalharm.operators.workflow import evaluate
    from signalharm.plans.tables import signals

    register_measure("largest_error", "lower", lambda p: F.array_max(F.zip_with(p.ref_y, p.y, lambda a, b: F.abs(b - a))))
    try:
        s = signals(spark, sf)
        fam = ("p08", "p09")
        harm = (
            s.select("class_id").distinct()
            .select(F.col("class_id").alias("cluster_id"), F.explode(F.array(*[F.lit(p) for p in fam])).alias("perturbation_id"))
            .select("*", F.explode(F.array(*[F.lit(a) for a in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8)])).alias("alpha"))
            .withColumn("y", F.col("alpha") + F.when(F.col("perturbation_id") == "p09", 0.3).otherwise(0.0) + F.col("cluster_id") / 100)
        )
        rows = {r.metric: r for r in evaluate(s, harm, ["mse", "mae", "largest_error"], "mse", fam, resamples=20, flips=500).collect()}
    finally:
        del MEASURES["largest_error"]
    assert set(rows) == {"mse", "mae", "largest_error"}
    r = rows["largest_error"]
    assert 0 <= r.ag <= 1 and r.ag_lower <= r.ag_upper and 0 < r.adjusted_p_oc <= 1
    assert rows["mse"].d_ag == 0.0


def plan(spark, sf, key):
    return entry.queries()[key](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    """Filters and columns reach the scan; the array path needs no Python and one shuffle
    (besides the spread of a one-file input)."""
    p = plan(spark, sf, "filter_allowed")
    assert "EqualTo(l_linestatus,O)" in p and "In(l_discount" in p
    assert "ReadSchema: struct<l_discount:double,l_linestatus:string>" in p
    p = plan(spark, sf, "measure_mse")
    assert p.count("Exchange hashpartitioning") == 1 and "Python" not in p
    assert "PartitionFilters: [isnotnull(dataset_id" in plan(spark, sf, "read_signal_store")
