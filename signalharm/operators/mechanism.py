"""Did the peak family do to the peaks what it claims? One row per cell and endpoint."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.peaks import match_peaks


def _row(endpoint: str, numerator, denominator, empty: str) -> Column:
    some = denominator > 0
    return F.struct(
        F.lit(endpoint).alias("endpoint_id"),
        F.when(some, numerator.cast("double")).otherwise(0.0).alias("numerator"),
        F.when(some, denominator.cast("long")).otherwise(0).cast("long").alias("denominator"),
        F.when(some, numerator / denominator).alias("value"),
        F.when(some, "complete_numeric").otherwise("complete_empty_risk_set").alias("state"),
        F.when(some, "").otherwise(empty).alias("reason_code"),
    )


def _ordinals(matches, side) -> Column:
    return F.transform(matches, lambda m: m[side])


def _positions(values) -> Column:
    """Events given as positions, in the shape the matcher reads."""
    return F.transform(F.array_sort(values), lambda v: F.struct(v.alias("pos")))


def _without(peaks, ordinals) -> Column:
    return A.lets(
        {"p": peaks, "o": ordinals},
        lambda s: F.filter(s["p"], lambda q, i: ~F.array_contains(s["o"], i)),
    )


def _pick(peaks, ordinals) -> Column:
    return A.lets(
        {"p": peaks, "o": ordinals},
        lambda s: F.filter(s["p"], lambda q, i: F.array_contains(s["o"], i)),
    )


def endpoints(cells: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Mechanism endpoints of perturbed cells.

    ``cells``: keys, perturbation_id, baseline and candidate peak lists, and the
    truth of the cell: ``supports`` array<struct<lo,hi>> (p02) and ``events``
    array<double> (deleted centres for p04, inserted ones for p05).
    """
    base, cand = F.col("baseline"), F.col("candidate")
    df = A.pin(cells, {"_m": match_peaks(base, cand, tolerance)})
    affected = F.transform(
        base, lambda p: F.exists("supports", lambda s: (s["lo"] <= p["pos"]) & (p["pos"] <= s["hi"]))
    )
    events = _positions(F.col("events"))
    df = A.pin(df, {"_a": affected, "_e": events})
    df = A.pin(
        df,
        {"_eb": match_peaks(F.col("_e"), base, tolerance), "_ec": match_peaks(F.col("_e"), cand, tolerance)},
    )
    eligible = _pick(F.col("_e"), _ordinals("_eb", "l"))
    df = A.pin(df, {"_el": match_peaks(eligible, cand, tolerance)})
    rest4 = (_without(base, _ordinals("_eb", "r")), _without(cand, _ordinals("_el", "r")))
    rest5 = (_without(base, _ordinals("_eb", "r")), _without(cand, _ordinals("_ec", "r")))
    df = A.pin(
        df,
        {
            "_r4": match_peaks(*rest4, tolerance),
            "_n4": F.size(rest4[0]),
            "_r5": match_peaks(*rest5, tolerance),
        },
    )
    n, hit = F.size(base), F.size("_m")

    def with_flag(flag):
        total = F.size(F.filter("_a", lambda a: a == flag))
        kept = F.size(F.filter("_m", lambda m: F.get("_a", m["l"]) == flag))
        return kept, total

    shift = F.aggregate("_m", F.lit(0.0), lambda acc, m: acc + m["d"])
    width = F.aggregate(
        "_m",
        F.lit(0.0),
        lambda acc, m: acc + F.log2(F.get("candidate", m["r"])["fwhm"] / F.get("baseline", m["l"])["fwhm"]),
    )
    no_base, no_match = "no_baseline_peaks", "no_matched_baseline_peaks"
    none = F.size("_e") == 0
    na = "not_applicable_zero_synthetic_events"

    def p05(endpoint, numerator, denominator, empty):
        return A.lets(
            {"r": _row(endpoint, numerator, denominator, empty)},
            lambda s: F.struct(
                F.lit(endpoint).alias("endpoint_id"),
                F.when(none, 0.0).otherwise(s["r"]["numerator"]).alias("numerator"),
                F.when(none, F.lit(0).cast("long")).otherwise(s["r"]["denominator"]).alias("denominator"),
                F.when(~none, s["r"]["value"]).alias("value"),
                F.when(none, na).otherwise(s["r"]["state"]).alias("state"),
                F.when(none, na).otherwise(s["r"]["reason_code"]).alias("reason_code"),
            ),
        )

    rows = {
        "p01": [_row("p01_retention", hit, n, no_base)],
        "p02": [
            _row("p02_affected_retention", *with_flag(True), "no_affected_baseline_peaks"),
            _row("p02_unaffected_retention", *with_flag(False), "no_unaffected_baseline_peaks"),
        ],
        "p03": [
            _row("p03_retention", hit, n, no_base),
            _row("p03_position_mae", shift, hit, no_match),
            _row("p03_log2_fwhm_ratio", width, hit, no_match),
        ],
        "p04": [
            _row("p04_disappearance", F.size("_eb") - F.size("_el"), F.size("_eb"), "no_baseline_matched_deleted_event"),
            _row("p04_undeleted_retention", F.size("_r4"), F.col("_n4"), "no_undeleted_baseline_peaks"),
        ],
        "p05": [
            p05("p05_detection_gain", F.size("_ec") - F.size("_eb"), F.size("_e"), na),
            p05("p05_native_retention", F.size("_r5"), F.col("_n4"), "no_native_baseline_peaks"),
        ],
    }
    chosen = F.lit(None)
    for name, parts in rows.items():
        chosen = F.when(F.col("perturbation_id") == name, F.array(*parts)).otherwise(chosen)
    keys = [c for c in cells.columns if c not in {"baseline", "candidate", "supports", "events"}]
    return df.select(*keys, F.inline(chosen))
