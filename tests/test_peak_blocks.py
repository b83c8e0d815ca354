"""Peak tables, scans and mechanism endpoints in blocks against the column expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalharm.functions.peaks import detect_peaks, range_threshold
from signalharm.operators import mechanism
from signalharm.operators import measure as M
from signalharm.operators import peak_blocks as PB
from signalharm.operators.blocks import sound
from signalharm.plans import q_measures, q_models


@pytest.fixture(scope="module")
def mixed(spark):
    """Noise, flat tops, ties, few peaks with room for false ones, no peaks, odd signals."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(20):
        n = 64 if i % 3 else 90
        axis = (np.arange(1, n + 1) * (1.0 if i % 2 else 1.7) + i % 4).tolist()
        y = rng.normal(size=n).round(1 if i % 4 else 6)
        if i in (5, 6):
            y = sum(h * np.exp(-0.5 * ((np.arange(n) - c) / 1.2) ** 2) for h, c in ((1, 9), (0.7, 25), (0.4, 44)))
        y = y.tolist()
        if i == 7:
            y = [2.0] * n
        if i == 8:
            y[3] = None
        if i == 9:
            y[30] = float("nan")
        if i == 10:
            axis, y = axis[:2], y[:2]
        rows.append((i if i != 12 else None, i % 3, axis, y))
    return spark.createDataFrame(rows, "signal_id long, class_id long, axis array<double>, y array<double>").cache()


def test_tables_equal_expressions(mixed):
    x, y = F.col("axis"), F.col("y")
    for r in mixed.filter(sound()).select("axis", "y", detect_peaks(x, y, range_threshold(y)).alias("p")).collect():
        own = PB.Peaks(np.array(r.axis), np.array(r.y))
        assert [i + 1 for i in own.idx] == [p.idx for p in r.p] and own.pos == [p.pos for p in r.p]
        for name, values in (("prom", own.prom), ("fwhm", own.fwhm()), ("area", own.area())):
            assert values == pytest.approx([p[name] for p in r.p], abs=1e-12)


def test_mechanism_equals_expressions(spark, mixed):
    own = mixed.filter(sound())
    key = ("signal_id", "perturbation_id", "alpha", "endpoint_id")
    cells = q_models.mechanism_cells(spark, None, own=own)
    want = {tuple(r[k] for k in key): r for r in mechanism.endpoints(cells).collect()}
    got = {tuple(r[k] for k in key): r for r in PB.mechanism_rows(own).collect()}
    assert got.keys() == want.keys() and len(got) > 800
    assert any(k[0] in (5, 6) and k[1] == "p05" and r.denominator for k, r in got.items())  # room for false peaks
    for k, r in want.items():
        g = got[k]
        assert (g.class_id, g.denominator, g.state, g.reason_code) == (r.class_id, r.denominator, r.state, r.reason_code), k
        assert g.numerator == pytest.approx(r.numerator) and (g.value is None) == (r.value is None), k
        assert r.value is None or g.value == pytest.approx(r.value, abs=1e-9), k


def test_scan_and_error_sums_equal_expressions(mixed):
    own, families = mixed.filter(sound()), ("p09", "p10")
    names = ["n_cells", "n_match", *PB.RATIOS]
    key = ["tolerance", "min_prominence", "perturbation_id", "alpha"]
    scan = PB.scan_sums(own, families, q_measures._TOLERANCES, q_measures._CUTS).groupBy(*key).agg(*[F.sum(n).alias(n) for n in names])
    got, want = ({tuple(r[k] for k in key): [r[n] for n in names] for r in df.collect()} for df in (scan, q_measures.scanned(own)))
    assert got.keys() == want.keys() and len(got) == 128
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    errors = M.matched_errors(q_measures.peak_pairs(own))
    cell = ["perturbation_id", "alpha"]
    want = {tuple(r)[:2]: tuple(r)[2:] for r in errors.groupBy(*cell).agg(*[F.count(e) for e in PB.ERRORS], *[F.sum(e) for e in PB.ERRORS]).collect()}
    parts = PB.error_sums(own, families).groupBy(*cell).agg(*[F.sum(f"n_{e}") for e in PB.ERRORS], *[F.sum(e) for e in PB.ERRORS])
    assert all(tuple(r)[2:] == pytest.approx(want[tuple(r)[:2]], abs=1e-9) for r in parts.collect())


def test_queries_scan_no_pairs_of_nodes(spark, sf):
    """Peaks of sound signals are found in Arrow batches: the expressions look at every pair of nodes."""
    for key in ("mechanism_endpoints", "peak_scans", "matched_peak_errors"):
        q = q_models.mechanism_endpoints if key == "mechanism_endpoints" else getattr(q_measures, key)
        p = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in p and "array_sort" not in p, key


def test_peaks_of_a_long_signal():
    y = np.cumsum(np.tile([3.0, -2.0], 100_000))  # every maximum is higher than all before it
    own = PB.Peaks(np.arange(len(y), dtype=float), np.append(y[:-1], 0.0))
    assert len(own.idx) == 1 and own.prom == [float(y[:-1].max()) - 1.0]  # the left side goes down to 1
