"""Projections on signals: orientation, resampling, normalising, smoothing, baselines."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def orient(axis, y) -> tuple[Column, Column]:
    """Reverse decreasing axes together with their values."""
    down = F.get(axis, F.lit(0)) > F.element_at(axis, -1)
    return F.when(down, F.reverse(axis)).otherwise(axis), F.when(down, F.reverse(y)).otherwise(y)


def grid(start: float, step: float, count: int) -> Column:
    """Regular axis start + k*step."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.lit(start) + k * F.lit(step))


def resample_state(axis, target, max_gap=None) -> Column:
    """'complete', or why a signal cannot be resampled to the target."""

    def state(s):
        inside = F.filter(
            s["x"], lambda v: (v >= F.get(s["t"], F.lit(0))) & (v <= F.element_at(s["t"], -1))
        )
        covered = (F.get(s["x"], F.lit(0)) <= F.get(s["t"], F.lit(0))) & (
            F.element_at(s["x"], -1) >= F.element_at(s["t"], -1)
        )
        out = F.when(~covered, "outside_support")
        if max_gap is not None:
            out = out.when(
                F.coalesce(F.array_max(A.differences(inside)) > max_gap, F.lit(True)), "native_gap"
            )
        return out.otherwise("complete")

    return A.lets({"x": axis, "t": target}, state)


def resample_linear(axis, y, target) -> Column:
    """Piecewise-linear values on ``target``; a node that is hit keeps its value."""
    return A.lets(
        {"x": axis, "y": y, "t": target},
        lambda s: F.transform(s["t"], lambda v: A.interpolate_at(s["x"], s["y"], v)),
    )


def pchip_slopes(axis, y) -> Column:
    """Shape-preserving node slopes: weighted harmonic mean of the secants."""

    def end(h0, h1, m0, m1):
        raw = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
        return A.let(
            raw,
            lambda d: F.when(F.signum(d) != F.signum(m0), 0.0)
            .when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3 * F.abs(m0)), 3 * m0)
            .otherwise(d),
        )

    def run(s):
        n = F.size(s["h"])
        h, m = (lambda k: F.get(s["h"], k)), (lambda k: F.get(s["m"], k))

        def slope(k):
            w1, w2 = 2 * h(k) + h(k - 1), h(k) + 2 * h(k - 1)
            inner = F.when(m(k - 1) * m(k) <= 0, 0.0).otherwise(
                (w1 + w2) / (w1 / m(k - 1) + w2 / m(k))
            )
            first = end(h(F.lit(0)), h(F.lit(1)), m(F.lit(0)), m(F.lit(1)))
            last = end(h(n - 1), h(n - 2), m(n - 1), m(n - 2))
            return F.when(k == 0, first).when(k == n, last).otherwise(inner)

        return F.transform(F.sequence(F.lit(0), n), slope)

    h = A.differences(axis)
    return A.lets(
        {"h": h, "m": F.zip_with(A.differences(y), h, lambda dy, dx: dy / dx)}, run
    )


def resample_pchip(axis, y, target) -> Column:
    def value(s, t):
        def hermite(b):
            h = F.get(s["x"], b["j"]) - F.get(s["x"], b["j"] - 1)
            u = (t - F.get(s["x"], b["j"] - 1)) / h
            y0, y1 = F.get(s["y"], b["j"] - 1), F.get(s["y"], b["j"])
            d0, d1 = F.get(s["d"], b["j"] - 1), F.get(s["d"], b["j"])
            return A.let(
                u,
                lambda v: y0 * (1 + 2 * v) * (1 - v) * (1 - v)
                + h * d0 * v * (1 - v) * (1 - v)
                + y1 * v * v * (3 - 2 * v)
                + h * d1 * v * v * (v - 1),
            )

        j = A.last_at_or_below(s["x"], t)
        return A.lets({"j": F.least(j, F.size(s["x"]) - 1)}, hermite)

    return A.lets(
        {"x": axis, "y": y, "t": target, "d": pchip_slopes(axis, y)},
        lambda s: F.transform(s["t"], lambda v: value(s, v)),
    )


RESAMPLERS = {"linear": resample_linear, "pchip": resample_pchip}


def normalize(axis, y, method: str) -> Column:
    """none, max, area or snv; null where the denominator is not positive."""
    if method == "none":
        return y
    if method == "max":
        return A.let(y, lambda v: A.divide(v, F.array_max(v)))
    if method == "area":
        return A.divide(y, A.trapezoid(axis, F.transform(y, lambda v: F.abs(v))))
    if method == "snv":
        return A.snv(y)
    raise ValueError(f"unknown method {method!r}")


def savgol_matrix(window: int = 11, order: int = 3) -> np.ndarray:
    """Row r gives the fitted value at offset r of one window."""
    t = np.arange(window) - window // 2
    design = np.vander(t, order + 1, increasing=True).astype(float)
    return design @ np.linalg.pinv(design)


def savgol(y, window: int = 11, order: int = 3) -> Column:
    """Polynomial smoothing; edge nodes use the outermost window's polynomial."""
    if window % 2 == 0 or order >= window:
        raise ValueError("window must be odd and longer than the order")
    rows = F.array(*[F.array(*[F.lit(float(w)) for w in r]) for r in savgol_matrix(window, order)])
    half = window // 2
    return A.lets(
        {"y": y, "c": rows},
        lambda s: F.when(
            F.size(s["y"]) >= window,
            F.transform(
                s["y"],
                lambda _, i: A.let(
                    F.least(F.greatest(i - half, F.lit(0)), F.size(s["y"]) - window),
                    lambda start: A.dot(
                        F.get(s["c"], i - start), F.slice(s["y"], start + 1, window)
                    ),
                ),
            ),
        ),
    )


def half_window(axis, width) -> Column:
    """Half-window in points for a width in axis units; null out of the domain."""
    return A.lets(
        {
            "h": F.rint(F.lit(float(width)) / A.median(A.differences(axis))).cast("int"),
            "m": F.floor((F.size(axis) - 1) / 2).cast("int"),
        },
        lambda s: F.when((s["h"] >= 1) & (s["h"] <= s["m"]), s["h"]),
    )


def _rolling(y, h, pick) -> Column:
    return A.lets(
        {"y": y, "h": h},
        lambda s: F.transform(
            s["y"],
            lambda _, i: pick(
                F.slice(
                    s["y"],
                    F.greatest(i - s["h"], F.lit(0)) + 1,
                    F.least(i + s["h"], F.size(s["y"]) - 1)
                    - F.greatest(i - s["h"], F.lit(0))
                    + 1,
                )
            ),
        ),
    )


def baseline_morph(axis, y, width) -> Column:
    """Opening, limited by the mean of its own dilation and erosion."""
    return A.lets(
        {"y": y, "h": half_window(axis, width)},
        lambda s: F.when(
            s["h"].isNotNull(),
            A.let(
                _rolling(_rolling(s["y"], s["h"], F.array_min), s["h"], F.array_max),
                lambda o: F.zip_with(
                    o,
                    F.zip_with(
                        _rolling(o, s["h"], F.array_max),
                        _rolling(o, s["h"], F.array_min),
                        lambda a, b: (a + b) / 2,
                    ),
                    lambda u, v: F.least(u, v),
                ),
            ),
        ),
    )


def baseline_snip(axis, y, width) -> Column:
    """Repeated clipping against the mean of the two nodes k steps away."""
    return A.lets(
        {"y": y, "h": half_window(axis, width)},
        lambda s: F.when(
            s["h"].isNotNull(),
            F.aggregate(
                F.sequence(F.lit(1), s["h"]),
                s["y"],
                lambda acc, k: F.transform(
                    acc,
                    lambda v, i: F.least(
                        v,
                        (
                            F.get(acc, F.greatest(i - k, F.lit(0)))
                            + F.get(acc, F.least(i + k, F.size(acc) - 1))
                        )
                        / 2,
                    ),
                ),
            ),
        ),
    )


BACKGROUND_TYPE = "struct<coefficients:array<double>,nrmse:double,log_ratio:double>"


def poly_background(background, template, axis, degree: int = 6) -> Column:
    """Legendre fit of a min-shifted, unit-RMS background on its own axis.

    Least squares has no built-in expression, so Arrow batches are solved with
    one pseudo-inverse per distinct axis in the batch.
    """

    @F.pandas_udf(BACKGROUND_TYPE)
    def fit(b: pd.Series, t: pd.Series, x: pd.Series) -> pd.DataFrame:
        solved: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        rows = []
        for raw, template_y, nodes in zip(b, t, x):
            raw, template_y, nodes = map(np.asarray, (raw, template_y, nodes))
            q = raw - raw.min()
            q_rms, t_rms = np.sqrt(np.mean(q * q)), np.sqrt(np.mean(template_y * template_y))
            if q_rms <= 0 or t_rms <= 0:
                rows.append((None, None, None))
                continue
            k = nodes.tobytes()
            if k not in solved:
                u = 2 * (nodes - nodes[0]) / (nodes[-1] - nodes[0]) - 1
                design = np.polynomial.legendre.legvander(u, degree)
                solved[k] = design, np.linalg.pinv(design)
            design, inverse = solved[k]
            c = inverse @ (q / q_rms)
            error = design @ c - q / q_rms
            rows.append((c, np.sqrt(np.mean(error * error)), np.log(q_rms / t_rms)))
        return pd.DataFrame(rows, columns=["coefficients", "nrmse", "log_ratio"])

    return fit(background, template, axis)


def pca_reconstruct(train: DataFrame, df: DataFrame, k: int, column: str = "y") -> DataFrame:
    """Fit k components on ``train`` rows of one axis; add ``reconstructed`` to ``df``.

    The model is n x k, bounded by the signal length; scoring is a projection
    with the components as literals.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    vectors = train.select(array_to_vector(F.col(column)).alias("v"))
    centre = np.array(vectors.select(Summarizer.mean(F.col("v"))).first()[0].toArray())
    components = PCA(k=k, inputCol="v", outputCol="s").fit(vectors).pc.toArray()

    def literal(v):
        return F.array(*[F.lit(float(x)) for x in v])

    mean = literal(centre)
    basis = F.array(*[literal(components[:, j]) for j in range(k)])
    value = A.lets(
        {"y": F.col(column), "m": mean, "b": basis},
        lambda s: A.let(
            F.zip_with(s["y"], s["m"], lambda u, v: u - v),
            lambda d: F.aggregate(
                s["b"],
                s["m"],
                lambda acc, c: A.let(
                    A.dot(d, c),
                    lambda w: F.zip_with(acc, c, lambda p, q: p + w * q),
                ),
            ),
        ),
    )
    return A.pin(df, {"reconstructed": value})


def param_grid(families: dict[str, dict[str, list[float]]]) -> Column:
    """Literal ``array<struct<system_id, method, parameters>>``: the hyper-parameter
    product of each family with a content id.  Explode it next to the signals."""
    cells = []
    for method, axes in families.items():
        names = sorted(axes)
        for combo in itertools.product(*[axes[n] for n in names]):
            values = {n: float(v) for n, v in zip(names, combo)}
            text = method + "|" + ",".join(f"{n}={v:.6f}" for n, v in values.items())
            pairs = [x for n, v in values.items() for x in (F.lit(n), F.lit(v))]
            cells.append(
                F.struct(
                    F.substring(F.sha2(F.lit(text), 256), 1, 16).alias("system_id"),
                    F.lit(method).alias("method"),
                    F.create_map(*pairs).alias("parameters"),
                )
            )
    return F.array(*cells)
