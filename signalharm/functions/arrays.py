"""Column expressions on ``array<double>`` signals.

One signal is one row, so everything here is a plain projection: no shuffle, no
Python.  Spark has no common-subexpression elimination inside lambdas, hence
``let``: it binds a value once and hands the lambda a variable, which keeps a
mean inside a ``transform`` from being recomputed per element.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value, body) -> Column:
    """Evaluate ``value`` once and use it in ``body(variable)``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lets(values: dict, body) -> Column:
    """Bind several values at once; ``body`` gets a struct variable."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def pin(df: DataFrame, values: dict) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer inlines single-use projections and copies them into pushed
    filters, which would put an expensive array expression inside a lambda.  A
    generator over a one-element array is a barrier for both rewrites.
    """
    keep = [c for c in df.columns if c not in values]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a) -> Column:
    """Null for an empty array."""
    return let(a, lambda v: F.try_divide(total(v), F.size(v)))


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda u, v: u * v))


def sum_squares(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


def rms(a) -> Column:
    """Null for an empty array."""
    return let(a, lambda v: F.sqrt(F.try_divide(sum_squares(v), F.size(v))))


def centre(a) -> Column:
    return lets({"v": a, "m": mean(a)}, lambda s: F.transform(s["v"], lambda x: x - s["m"]))


def std_pop(a) -> Column:
    return rms(centre(a))


def scale(a, factor) -> Column:
    return lets({"v": a, "f": factor}, lambda s: F.transform(s["v"], lambda x: x * s["f"]))


def divide(a, denominator) -> Column:
    """Element-wise division; null where the denominator is not positive."""
    return lets(
        {"v": a, "d": denominator},
        lambda s: F.when(s["d"] > 0, F.transform(s["v"], lambda x: x / s["d"])),
    )


def differences(a) -> Column:
    return let(
        a,
        lambda v: F.zip_with(
            F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda nxt, cur: nxt - cur
        ),
    )


def median(a) -> Column:
    return let(
        F.sort_array(a),
        lambda s: (
            F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))
            + F.get(s, F.floor(F.size(s) / 2).cast("int"))
        )
        / 2,
    )


def quantile(a, q: float) -> Column:
    """Linear-interpolation quantile of one array."""
    return let(
        F.sort_array(a),
        lambda s: lets(
            {"s": s, "h": (F.size(s) - 1) * F.lit(q)},
            lambda t: F.get(t["s"], F.floor(t["h"]).cast("int"))
            + (t["h"] - F.floor(t["h"]))
            * (
                F.get(t["s"], F.ceil(t["h"]).cast("int"))
                - F.get(t["s"], F.floor(t["h"]).cast("int"))
            ),
        ),
    )


def node_widths(axis) -> Column:
    """Trapezoid weight of each node: half the distance between its neighbours."""
    return let(
        axis,
        lambda x: F.transform(
            x,
            lambda _, i: (
                F.get(x, F.least(i + 1, F.size(x) - 1)) - F.get(x, F.greatest(i - 1, F.lit(0)))
            )
            / 2,
        ),
    )


def trapezoid(axis, y) -> Column:
    return dot(node_widths(axis), y)


def snv(a) -> Column:
    """Centre and divide by the population deviation; null when constant."""
    return divide(centre(a), std_pop(a))


def l2_normalize(a) -> Column:
    return divide(a, F.sqrt(sum_squares(a)))


def last_at_or_below(sorted_axis, t) -> Column:
    """1-based position of the last node <= t (0 when none), by binary search."""
    return lets(
        {
            "x": sorted_axis,
            "t": t,
            "p": F.transform(
                F.sequence(F.floor(F.log2(F.size(sorted_axis))).cast("int"), F.lit(0), F.lit(-1)),
                lambda k: F.pow(F.lit(2.0), k).cast("int"),
            ),
        },
        lambda s: F.aggregate(
            s["p"],
            F.lit(0),
            lambda pos, step: F.when(
                (pos + step <= F.size(s["x"]))
                & (F.get(s["x"], pos + step - 1) <= s["t"]),
                pos + step,
            ).otherwise(pos),
        ),
    )


def interpolate_at(axis, y, t) -> Column:
    """Piecewise-linear value at t; null outside the support."""
    return lets(
        {"x": axis, "y": y, "t": t, "j": last_at_or_below(axis, t)},
        lambda s: F.when(
            F.get(s["x"], s["j"] - 1) == s["t"], F.get(s["y"], s["j"] - 1)
        ).when(
            (s["j"] >= 1) & (s["j"] < F.size(s["x"])),
            F.get(s["y"], s["j"] - 1)
            + (s["t"] - F.get(s["x"], s["j"] - 1))
            / (F.get(s["x"], s["j"]) - F.get(s["x"], s["j"] - 1))
            * (F.get(s["y"], s["j"]) - F.get(s["y"], s["j"] - 1)),
        ),
    )


def position_to_axis(axis, p) -> Column:
    """Axis value at fractional 1-based index p."""
    return lets(
        {"x": axis, "p": p},
        lambda s: F.get(s["x"], F.floor(s["p"]).cast("int") - 1)
        + (s["p"] - F.floor(s["p"]))
        * (
            F.coalesce(F.get(s["x"], F.floor(s["p"]).cast("int")), F.lit(0.0))
            - F.get(s["x"], F.floor(s["p"]).cast("int") - 1)
        ),
    )


def index_filter(n_from, n_to, predicate) -> Column:
    """Indices in [n_from, n_to] that satisfy ``predicate``; empty when the range is."""
    return F.when(
        n_from <= n_to, F.filter(F.sequence(n_from, n_to), predicate)
    ).otherwise(F.array().cast("array<int>"))


def rounded(column, digits: int = 6) -> Column:
    """Round and drop the sign of zero."""
    return F.round(column, digits) + F.lit(0.0)
