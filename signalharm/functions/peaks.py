"""Peak tables inside one signal row.

A peak list is ``array<struct<idx,pos,height,prom,fwhm,area>>`` bounded by the
signal's own length, so detection, components and one-to-one matching are
projections.  Indices are 1-based.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A


def _at(a, i) -> Column:
    return F.get(a, i - 1)


def _crossing(x, y, level, lower, upper) -> Column:
    """Axis value where the straight line between two neighbours meets ``level``."""
    return _at(x, lower) + (level - _at(y, lower)) / (_at(y, upper) - _at(y, lower)) * (
        _at(x, upper) - _at(x, lower)
    )


def _width_and_area(x, y, p) -> Column:
    """FWHM at half prominence and area above the higher base."""
    half = _at(y, p["idx"]) - 0.5 * p["prom"]

    def below_left(level):
        return F.array_max(A.index_filter(F.lit(1), p["idx"] - 1, lambda j: _at(y, j) <= level))

    def below_right(level):
        return F.array_min(A.index_filter(p["idx"] + 1, F.size(y), lambda j: _at(y, j) <= level))

    def area(s):
        xl = _crossing(x, y, p["contour"], s["al"], s["al"] + 1)
        xr = _crossing(x, y, p["contour"], s["ar"], s["ar"] - 1)
        inner = F.when(
            s["ar"] - s["al"] > 2,
            F.aggregate(
                F.sequence(s["al"] + 1, s["ar"] - 2),
                F.lit(0.0),
                lambda acc, j: acc
                + (_at(x, j + 1) - _at(x, j))
                * (_at(y, j) + _at(y, j + 1) - 2 * p["contour"])
                / 2,
            ),
        ).otherwise(0.0)
        return (
            inner
            + (_at(x, s["al"] + 1) - xl) * (_at(y, s["al"] + 1) - p["contour"]) / 2
            + (xr - _at(x, s["ar"] - 1)) * (_at(y, s["ar"] - 1) - p["contour"]) / 2
        )

    return A.lets(
        {
            "l": below_left(half),
            "r": below_right(half),
            "al": below_left(p["contour"]),
            "ar": below_right(p["contour"]),
            "half": half,
        },
        lambda s: F.struct(
            p["idx"].alias("idx"),
            _at(x, p["idx"]).alias("pos"),
            _at(y, p["idx"]).alias("height"),
            p["prom"].alias("prom"),
            (
                _crossing(x, y, s["half"], s["r"], s["r"] - 1)
                - _crossing(x, y, s["half"], s["l"], s["l"] + 1)
            ).alias("fwhm"),
            area(s).alias("area"),
        ),
    )


def detect_peaks(axis, y, threshold) -> Column:
    """Strict local maxima whose prominence reaches ``threshold``, by position."""

    def prominence(x, v, i):
        bounds = {
            "i": i,
            "l": F.coalesce(
                F.array_max(A.index_filter(F.lit(1), i - 1, lambda j: _at(v, j) > _at(v, i))),
                F.lit(0),
            ),
            "r": F.coalesce(
                F.array_min(A.index_filter(i + 1, F.size(v), lambda j: _at(v, j) > _at(v, i))),
                F.size(v) + 1,
            ),
        }
        return A.lets(
            bounds,
            lambda b: A.let(
                F.greatest(
                    F.array_min(F.slice(v, b["l"] + 1, b["i"] - b["l"])),
                    F.array_min(F.slice(v, b["i"], b["r"] - b["i"])),
                ),
                lambda c: F.struct(
                    b["i"].alias("idx"), (_at(v, b["i"]) - c).alias("prom"), c.alias("contour")
                ),
            ),
        )

    def run(s):
        maxima = A.index_filter(
            F.lit(2),
            F.size(s["y"]) - 1,
            lambda i: (_at(s["y"], i) > _at(s["y"], i - 1)) & (_at(s["y"], i) > _at(s["y"], i + 1)),
        )
        kept = F.filter(
            F.transform(maxima, lambda i: prominence(s["x"], s["y"], i)),
            lambda p: p["prom"] >= s["t"],
        )
        return F.transform(kept, lambda p: _width_and_area(s["x"], s["y"], p))

    return A.lets({"x": axis, "y": y, "t": threshold}, run)


def range_threshold(y, fraction: float = 0.05) -> Column:
    return A.let(y, lambda v: fraction * (F.array_max(v) - F.array_min(v)))


def robust_threshold(y, fraction: float) -> Column:
    """Fraction of the q99 - q01 range."""
    return A.let(y, lambda v: fraction * (A.quantile(v, 0.99) - A.quantile(v, 0.01)))


def peak_components(axis, y, peaks) -> Column:
    """Support (midpoints between neighbours) and positive part above its chord.

    Returns ``array<struct<peak fields, rank, lo, hi, component, comp_height, comp_area>>``
    where rank orders peaks from weakest by (prominence, position).
    """

    def build(s):
        n = F.size(s["p"])
        order = F.array_sort(
            F.transform(
                s["p"],
                lambda p: F.struct(p["prom"].alias("prom"), p["pos"].alias("pos"), p["idx"].alias("idx")),
            )
        )
        return A.let(
            order,
            lambda o: F.transform(
                s["p"],
                lambda p, k: A.lets(
                    {
                        "lo": F.when(k == 0, F.lit(1)).otherwise(
                            F.floor((F.get(s["p"], k - 1)["idx"] + p["idx"]) / 2).cast("int")
                        ),
                        "hi": F.when(k == n - 1, F.size(s["y"])).otherwise(
                            F.floor((F.get(s["p"], k + 1)["idx"] + p["idx"]) / 2).cast("int")
                        ),
                        "rank": F.array_position(F.transform(o, lambda q: q["idx"]), p["idx"]).cast("int"),
                    },
                    lambda b: A.let(
                        F.transform(
                            F.sequence(b["lo"], b["hi"]),
                            lambda i: F.greatest(
                                _at(s["y"], i)
                                - (
                                    _at(s["y"], b["lo"])
                                    + (_at(s["x"], i) - _at(s["x"], b["lo"]))
                                    / (_at(s["x"], b["hi"]) - _at(s["x"], b["lo"]))
                                    * (_at(s["y"], b["hi"]) - _at(s["y"], b["lo"]))
                                ),
                                F.lit(0.0),
                            ),
                        ),
                        lambda c: F.struct(
                            *[p[f].alias(f) for f in ("idx", "pos", "height", "prom", "fwhm", "area")],
                            b["rank"].alias("rank"),
                            b["lo"].alias("lo"),
                            b["hi"].alias("hi"),
                            c.alias("component"),
                            F.get(c, p["idx"] - b["lo"]).alias("comp_height"),
                            # the component is zero at both support ends, so the
                            # neighbours outside the support add no area
                            A.trapezoid(
                                F.slice(s["x"], b["lo"], b["hi"] - b["lo"] + 1), c
                            ).alias("comp_area"),
                        ),
                    ),
                ),
            ),
        )

    return A.lets({"x": axis, "y": y, "p": peaks}, build)


def match_peaks(ref_peaks, cand_peaks, tolerance) -> Column:
    """One-to-one greedy matching in order (distance, reference, candidate position).

    Returns ``array<struct<d, l, r>>`` with 0-based peak ordinals.
    """

    def run(s):
        pairs = F.flatten(
            F.transform(
                s["a"],
                lambda p, i: F.filter(
                    F.transform(
                        s["b"],
                        lambda q, j: F.struct(
                            F.abs(q["pos"] - p["pos"]).alias("d"), i.alias("l"), j.alias("r")
                        ),
                    ),
                    lambda c: c["d"] <= s["t"],
                ),
            )
        )
        return F.aggregate(
            F.array_sort(pairs),
            F.array().cast("array<struct<d:double,l:int,r:int>>"),
            lambda acc, c: F.when(
                F.exists(acc, lambda m: (m["l"] == c["l"]) | (m["r"] == c["r"])), acc
            ).otherwise(F.concat(acc, F.array(c))),
        )

    return A.lets({"a": ref_peaks, "b": cand_peaks, "t": tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))}, run)


def ratios(n_ref, n_cand, n_match) -> Column:
    """Precision, recall, F1, artifact and missing ratio with the empty-set rules."""
    tp = n_match.cast("double")
    precision = F.when(n_cand == 0, 1.0).otherwise(tp / n_cand)
    recall = F.when(n_ref == 0, 1.0).otherwise(tp / n_ref)
    f1 = F.when((n_ref + n_cand) == 0, 1.0).otherwise(2 * tp / (n_ref + n_cand))
    return F.struct(
        precision.alias("peak_precision"),
        recall.alias("peak_recall"),
        f1.alias("peak_f1"),
        F.when(n_cand == 0, 0.0).otherwise((n_cand - tp) / n_cand).alias("artifact_ratio"),
        F.when(n_ref == 0, 0.0).otherwise((n_ref - tp) / n_ref).alias("missing_ratio"),
    )


def match_counts(pair, tolerance: float = 2.0) -> Column:
    """Peak-set outputs of a signal pair, detecting peaks on both sides."""
    return A.lets(
        {
            "a": detect_peaks(pair.ref_axis, pair.ref_y, range_threshold(pair.ref_y)),
            "b": detect_peaks(pair.axis, pair.y, range_threshold(pair.y)),
        },
        lambda s: A.let(
            F.size(match_peaks(s["a"], s["b"], tolerance)),
            lambda m: ratios(F.size(s["a"]), F.size(s["b"]), m),
        ),
    )
