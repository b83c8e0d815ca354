"""Quality measures of a (reference, candidate) pair as column expressions.

A pair row holds ``ref_axis, ref_y, axis, y``.  Undefined inputs (zero norm,
zero variance, zero mass) give null.  ``MEASURES`` is the open registry: add an
output with :func:`register_measure`.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A
from .peak_counts import peak_outputs, peak_ratio
from .peaks import match_counts

MAD_TO_SIGMA = 0.6744897501960817  # 0.75 quantile of the standard normal


@dataclass(frozen=True)
class Pair:
    """Column handles of one signal pair."""

    ref_axis: Column
    ref_y: Column
    axis: Column
    y: Column


@dataclass(frozen=True)
class Measure:
    """``bundle`` names an expression of BUNDLES that several outputs share; ``value`` reads this output from it.

    ``reason(pair)`` says why the output is null, where it is.
    """

    output_id: str
    direction: str  # lower | higher | target | non_monotonic
    expression: Callable[[Pair], Column]
    target: float | None = None
    reason: Callable[[Pair], Column] | None = None
    bundle: str | None = None
    value: Callable[[Column], Column] | None = None


def _clip(c) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def moments(p: Pair) -> Column:
    """One pass over the pair: squared and absolute differences, squared reference, points."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("sq", "ab", "rr")])

    def add(acc, v):
        return F.struct(
            (acc["sq"] + (v["b"] - v["a"]) * (v["b"] - v["a"])).alias("sq"),
            (acc["ab"] + F.abs(v["b"] - v["a"])).alias("ab"),
            (acc["rr"] + v["a"] * v["a"]).alias("rr"),
        )

    pairs = F.zip_with(p.ref_y, p.y, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    return F.struct(F.aggregate(pairs, zero, add).alias("m"), F.size(p.ref_y).alias("n"))


def _from_moments(value: Callable[[Column], Column]) -> Callable[[Pair], Column]:
    return lambda p: A.let(moments(p), value)


def _mse(b):
    return F.try_divide(b["m"]["sq"], b["n"])


def _mae(b):
    return F.try_divide(b["m"]["ab"], b["n"])


def _nmse(b):
    return F.when(b["m"]["rr"] > 0, b["m"]["sq"] / b["m"]["rr"])


mse, mae, nmse = _from_moments(_mse), _from_moments(_mae), _from_moments(_nmse)
rmse = _from_moments(lambda b: F.sqrt(_mse(b)))


def cosine(a, b) -> Column:
    return A.lets(
        {"d": A.dot(a, b), "n": F.sqrt(A.sum_squares(a)) * F.sqrt(A.sum_squares(b))},
        lambda s: F.when(s["n"] > 0, _clip(s["d"] / s["n"])),
    )


def sam(p: Pair) -> Column:
    """Angle between the vectors, by the chord of the unit vectors.

    Equals acos of the cosine, but stays exact for (nearly) equal directions,
    where acos magnifies a rounding error to 1e-8.
    """
    return A.lets(
        {"u": A.l2_normalize(p.ref_y), "v": A.l2_normalize(p.y)},
        lambda s: A.let(
            F.sqrt(A.sum_squares(F.zip_with(s["u"], s["v"], lambda a, b: a - b))) / 2,
            lambda h: F.when(h.isNotNull(), 2 * F.asin(F.least(h, F.lit(1.0)))),
        ),
    )


def pearson(p: Pair) -> Column:
    return A.lets(
        {"a": A.centre(p.ref_y), "b": A.centre(p.y)}, lambda s: cosine(s["a"], s["b"])
    )


def mass(axis, y) -> Column:
    """Positive part times trapezoid width, normalised to one; null without mass."""
    raw = F.zip_with(A.node_widths(axis), y, lambda w, v: w * F.greatest(v, F.lit(0.0)))
    return A.let(raw, lambda m: A.divide(m, A.total(m)))


def wasserstein_1(p: Pair) -> Column:
    """Integral of |CDF difference| over the merged support; the axes may differ."""

    def events(axis, y, factor):
        return F.zip_with(
            axis, mass(axis, y), lambda x, m: F.struct(x.alias("x"), (m * factor).alias("m"))
        )

    merged = F.array_sort(
        F.concat(events(p.ref_axis, p.ref_y, -1.0), events(p.axis, p.y, 1.0))
    )
    return A.let(
        merged,
        lambda e: F.aggregate(
            e,
            F.struct(
                F.get(e, F.lit(0))["x"].alias("x"), F.lit(0.0).alias("f"), F.lit(0.0).alias("w")
            ),
            lambda s, v: F.struct(
                v["x"].alias("x"),
                (s["f"] + v["m"]).alias("f"),
                (s["w"] + F.abs(s["f"]) * (v["x"] - s["x"])).alias("w"),
            ),
            lambda s: s["w"],
        ),
    )


def negative_area(axis, y) -> Column:
    """Width-weighted negative area over absolute area."""
    return A.lets(
        {
            "n": A.total(
                F.zip_with(A.node_widths(axis), y, lambda w, v: w * F.greatest(-v, F.lit(0.0)))
            ),
            "a": A.total(F.zip_with(A.node_widths(axis), y, lambda w, v: w * F.abs(v))),
        },
        lambda s: F.when(s["a"] > 0, s["n"] / s["a"]),
    )


def structure_to_noise(y) -> Column:
    """Population deviation over the robust noise of first differences."""
    return A.lets(
        {"d": A.differences(y), "s": A.std_pop(y), "n": F.size(y)},
        lambda t: A.lets(
            {"d": t["d"], "m": A.median(t["d"])},
            lambda u: A.let(
                A.median(F.transform(u["d"], lambda v: F.abs(v - u["m"])))
                / (MAD_TO_SIGMA * math.sqrt(2.0)),
                lambda noise: F.when((t["n"] >= 3) & (noise > 0), t["s"] / noise),
            ),
        ),
    )


#: Expressions that several outputs share: computed once per pair.
BUNDLES: dict[str, Callable[[Pair], Column]] = {"moments": moments, "peaks": peak_outputs}
#: Bundles that are Arrow functions: columns of their own, never inside a lambda.
ARROW_BUNDLES = {"peaks"}


def _empty(*values) -> Column:
    sizes = [F.coalesce(F.size(v), F.lit(0)) <= 0 for v in values]
    return sizes[0] if len(sizes) == 1 else sizes[0] | sizes[1]


def _not_finite(v) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def paired_reason(last: str) -> Callable[[Pair], Column]:
    """Why an output of index-aligned values is null; ``last`` where the inputs are sound."""
    return lambda p: (
        F.when(_empty(p.ref_y, p.y), "empty_signal")
        .when(F.size(p.ref_y) != F.size(p.y), "length_mismatch")
        .when(_not_finite(p.ref_y) | _not_finite(p.y), "not_finite")
        .otherwise(last)
    )


def _transport_reason(p: Pair) -> Column:
    return (
        F.when(_empty(p.ref_y, p.y), "empty_signal")
        .when(_not_finite(p.ref_y) | _not_finite(p.y), "not_finite")
        .otherwise("no_positive_mass")
    )


def _noise_reason(p: Pair) -> Column:
    return (
        F.when(_empty(p.y), "empty_signal")
        .when(_not_finite(p.y), "not_finite")
        .when(F.size(p.y) < 3, "too_few_points")
        .otherwise("zero_noise")
    )


MEASURES: dict[str, Measure] = {}


def register_measure(output_id, direction, expression, target=None, reason=None, bundle=None, value=None) -> Measure:
    """Add a measure ``expression(pair) -> Column`` under ``output_id``.

    ``bundle`` and ``value``: the output is ``value(BUNDLES[bundle](pair))``, and
    measures of one bundle share its evaluation.
    """
    if direction not in {"lower", "higher", "target", "non_monotonic"}:
        raise ValueError(f"unknown direction {direction!r}")
    if (direction == "target") != (target is not None):
        raise ValueError("a target value belongs to direction 'target' only")
    if (bundle is None) != (value is None):
        raise ValueError("a bundle needs the value read from it")
    MEASURES[output_id] = Measure(output_id, direction, expression, target, reason, bundle, value)
    return MEASURES[output_id]


_pairwise = paired_reason("undefined_for_input")
register_measure("mse", "lower", mse, reason=_pairwise, bundle="moments", value=_mse)
register_measure("rmse", "lower", rmse, reason=_pairwise, bundle="moments", value=lambda b: F.sqrt(_mse(b)))
register_measure("mae", "lower", mae, reason=_pairwise, bundle="moments", value=_mae)
register_measure("nmse", "lower", nmse, reason=paired_reason("zero_reference_norm"), bundle="moments", value=_nmse)
register_measure("sam", "lower", sam, reason=paired_reason("zero_norm"))
register_measure("pearson", "higher", pearson, reason=paired_reason("zero_variance"))
register_measure("wasserstein_1", "lower", wasserstein_1, reason=_transport_reason)
register_measure("structure_to_noise", "higher", lambda p: structure_to_noise(p.y), reason=_noise_reason)


def _register_peaks(name: str, direction: str) -> None:
    register_measure(name, direction, lambda p: match_counts(p)[name], bundle="peaks", value=peak_ratio(name))


for _name, _direction in (
    ("peak_precision", "higher"),
    ("peak_recall", "higher"),
    ("peak_f1", "higher"),
    ("artifact_ratio", "lower"),
    ("missing_ratio", "lower"),
):
    _register_peaks(_name, _direction)
