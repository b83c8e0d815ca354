"""Graded perturbations: signals x conditions, one output row per cell.

The random state of a (signal, perturbation) is hashed once, before the
condition list is exploded, and shared by all strengths.  The whole family is
one map-side projection; conditions are a literal array, so nothing shuffles.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from ..functions.peaks import detect_peaks, peak_components, range_threshold

# Strength grid, random root, kernel length, largest axis change.
ALPHAS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8)
PERTURBATIONS = tuple(f"p{k:02d}" for k in range(1, 13))
SEED = 20260817
CORRELATION_LENGTH = 20.0
MAX_AXIS_CHANGE = 4.0
PROPOSAL_LIMIT = 10_000
SIGMA_PER_FWHM = 0.42466090014400953  # 1 / (2 sqrt(2 ln 2))


def positive_grid(perturbations=PERTURBATIONS, alphas=ALPHAS) -> list[tuple[str, float]]:
    """Every perturbation at every positive strength."""
    return [(p, a) for p in perturbations for a in alphas if a > 0]


def condition_array(perturbations=PERTURBATIONS, alphas=ALPHAS, identity: bool = True) -> Column:
    """Literal ``array<struct<perturbation_id, alpha>>``; the identity row is ('id', 0)."""
    rows = ([("id", 0.0)] if identity else []) + positive_grid(perturbations, alphas)
    return F.array(
        *[F.struct(F.lit(p).alias("perturbation_id"), F.lit(a).alias("alpha")) for p, a in rows]
    )


def _standardise(a) -> Column:
    """Centre and scale to unit root mean square."""
    return A.let(A.centre(a), lambda c: A.divide(c, A.rms(c)))


def drift_shape(signal_id, axis, seed=SEED) -> Column:
    """Random Legendre curve of degree 2..4 without its constant and linear terms."""

    def curve(s):
        def c(k):
            return F.when(s["deg"] >= k, H.normal(seed, "p08", s["id"], k)).otherwise(0.0)

        return A.lets(
            {"x": s["x"], "c2": c(2), "c3": c(3), "c4": c(4)},
            lambda t: F.transform(
                t["x"],
                lambda v: A.let(
                    -1 + 2 * (v - F.get(t["x"], F.lit(0))) / (F.element_at(t["x"], -1) - F.get(t["x"], F.lit(0))),
                    lambda u: t["c2"] * (3 * u * u - 1) / 2
                    + t["c3"] * (5 * u * u * u - 3 * u) / 2
                    + t["c4"] * (35 * u * u * u * u - 30 * u * u + 3) / 8,
                ),
            ),
        )

    return _standardise(
        A.lets(
            {"id": signal_id, "x": axis, "deg": 2 + H.draw_index(3, seed, "p08deg", signal_id)},
            curve,
        )
    )


def white_noise(signal_id, n, perturbation="p09", seed=SEED) -> Column:
    return A.let(
        signal_id,
        lambda s: F.transform(F.sequence(F.lit(1), n), lambda i: H.normal(seed, perturbation, s, i)),
    )


def smoothing_kernel(axis, length=CORRELATION_LENGTH) -> Column:
    """Row-normalised Gaussian kernel of one axis: one array of weights per node."""
    return A.let(
        axis,
        lambda x: F.transform(
            x,
            lambda xi: A.let(
                F.transform(x, lambda xj: F.exp(-0.5 * F.pow((xi - xj) / length, F.lit(2.0)))),
                lambda w: A.divide(w, A.total(w)),
            ),
        ),
    )


def correlated_noise(signal_id, axis, seed=SEED, kernel=None) -> Column:
    """White noise through the axis kernel, centred, unit root mean square."""
    return _standardise(
        A.lets(
            {
                "z": white_noise(signal_id, F.size(axis), "p10", seed),
                "k": smoothing_kernel(axis) if kernel is None else kernel,
            },
            lambda s: F.transform(s["k"], lambda w: A.dot(w, s["z"])),
        )
    )


def _axis_out(perturbation, alpha, axis) -> Column:
    return (
        F.when(
            perturbation == "p11",
            A.lets(
                {"x": axis, "d": MAX_AXIS_CHANGE * alpha},
                lambda s: F.transform(s["x"], lambda v: v + s["d"]),
            ),
        )
        .when(
            perturbation == "p12",
            A.lets(
                {
                    "x": axis,
                    "lo": F.get(axis, F.lit(0)),
                    "span": F.element_at(axis, -1) - F.get(axis, F.lit(0)),
                    "d": MAX_AXIS_CHANGE * alpha,
                },
                lambda s: F.transform(
                    s["x"],
                    lambda v: v
                    + s["d"] * (v - s["lo"]) / s["span"] * ((v - s["lo"]) / s["span"]),
                ),
            ),
        )
        .otherwise(axis)
    )


def _tile(parts_of) -> Callable[[Column], Column]:
    """Join per-peak slices end to end; neighbours share one (zero) node."""

    def build(peaks):
        return F.flatten(
            F.transform(
                peaks,
                lambda p, k: A.let(
                    parts_of(p),
                    lambda c: F.slice(
                        c, 1, F.size(c) - F.when(k == F.size(peaks) - 1, 0).otherwise(1)
                    ),
                ),
            )
        )

    return build


def removed_components(peaks, keep) -> Column:
    """Sum of the components whose peak satisfies ``keep``, per node."""
    return A.let(
        peaks,
        _tile(
            lambda p: A.lets(
                {"c": p["component"], "w": F.when(keep(p), 1.0).otherwise(0.0)},
                lambda s: F.transform(s["c"], lambda v: v * s["w"]),
            )
        ),
    )


def weak_count(alpha, n_peaks) -> Column:
    """Weakest peaks selected at this strength."""
    return F.least(F.ceil(alpha * n_peaks).cast("int"), n_peaks)


def median_fwhm(peaks) -> Column:
    return A.median(F.transform(peaks, lambda p: p["fwhm"]))


def median_component_height(peaks) -> Column:
    return A.median(F.transform(peaks, lambda p: p["comp_height"]))


def broadened(axis, y, peaks, alpha) -> Column:
    """Each component replaced by a Gaussian of its own realised area."""

    def peak_curve(s, p):
        return A.lets(
            {
                "g": F.transform(
                    s["x"],
                    lambda v: F.exp(-0.5 * ((v - p["pos"]) / s["sig"]) * ((v - p["pos"]) / s["sig"])),
                )
            },
            lambda t: A.scale(t["g"], p["comp_area"] / A.dot(s["w"], t["g"])),
        )

    return A.lets(
        {
            "x": axis,
            "w": A.node_widths(axis),
            "sig": alpha * median_fwhm(peaks),
            "p": peaks,
            "base": F.zip_with(y, removed_components(peaks, lambda p: F.lit(True)), lambda a, b: a - b),
        },
        lambda s: F.aggregate(
            s["p"],
            s["base"],
            lambda acc, p: F.zip_with(acc, peak_curve(s, p), lambda a, b: a + b),
        ),
    )


def false_centres(signal_id, axis, peaks, seed=SEED, limit=PROPOSAL_LIMIT, strongest=max(ALPHAS)) -> Column:
    """Uniform proposals kept while at least two FWHM from peaks and each other.

    Enough for ``strongest``, unless ``limit`` proposals do not yield them: then
    the perturbation has no result for that signal.
    """
    return A.lets(
        {
            "id": signal_id,
            "lo": F.get(axis, F.lit(0)),
            "hi": F.element_at(axis, -1),
            "pos": F.transform(peaks, lambda p: p["pos"]),
            "r": 2.0 * median_fwhm(peaks),
            "n": F.floor(F.lit(float(strongest)) * F.size(peaks)).cast("int"),
        },
        lambda s: F.aggregate(
            F.sequence(F.lit(0), F.lit(limit - 1)),
            F.array().cast("array<double>"),
            lambda acc, k: F.when(F.size(acc) >= s["n"], acc).otherwise(
                A.let(
                    s["lo"] + (s["hi"] - s["lo"]) * H.uniform(seed, "p05", s["id"], k),
                    lambda c: F.when(
                        F.exists(s["pos"], lambda q: F.abs(c - q) < s["r"])
                        | F.exists(acc, lambda q: F.abs(c - q) < s["r"]),
                        acc,
                    ).otherwise(F.concat(acc, F.array(c))),
                )
            ),
        ),
    )


def with_false_peaks(axis, y, peaks, centres, alpha) -> Column:
    """Add the first floor(alpha n) false Gaussians of median height and width."""
    return A.lets(
        {
            "x": axis,
            "h": median_component_height(peaks),
            "sig": SIGMA_PER_FWHM * median_fwhm(peaks),
            "c": F.slice(centres, 1, F.floor(alpha * F.size(peaks)).cast("int")),
            "y": y,
        },
        lambda s: F.zip_with(
            s["x"],
            s["y"],
            lambda v, base: base
            + F.aggregate(
                s["c"],
                F.lit(0.0),
                lambda acc, c: acc
                + s["h"] * F.exp(-0.5 * ((v - c) / s["sig"]) * ((v - c) / s["sig"])),
            ),
        ),
    )


def perturb(
    signals: DataFrame,
    perturbations=PERTURBATIONS,
    alphas=ALPHAS,
    identity: bool = True,
    seed: int = SEED,
    baseline_col: str | None = None,
    kernel_col: str | None = None,
) -> DataFrame:
    """Apply the condition grid to ``signals(signal_id, axis, y, ...)``.

    Adds ``perturbation_id, alpha, ref_axis, ref_y`` and replaces ``axis, y``.
    p06/p07 need ``baseline_col``; ``kernel_col`` supplies a kernel computed
    once per distinct axis.  Signals without peaks (p01..p05), or without room
    for the false peaks (p05), give a null ``y`` at that condition.
    """
    wanted = set(perturbations)
    unknown = wanted - set(PERTURBATIONS) - set(CUSTOM)
    if unknown:
        raise ValueError(f"unknown perturbations {sorted(unknown)}")
    if wanted & {"p06", "p07"} and baseline_col is None:
        raise ValueError("p06 and p07 need baseline_col")
    df = signals.withColumns({"ref_axis": F.col("axis"), "ref_y": F.col("y")})
    state: dict[str, Column] = {"_rms": A.rms("y")}
    if "p08" in wanted:
        state["_drift"] = drift_shape(F.col("signal_id"), F.col("axis"), seed)
    if "p09" in wanted:
        state["_white"] = white_noise(F.col("signal_id"), F.size("y"), "p09", seed)
    if "p10" in wanted:
        kernel = None if kernel_col is None else F.col(kernel_col)
        state["_corr"] = correlated_noise(F.col("signal_id"), F.col("axis"), seed, kernel)
    if wanted & {"p01", "p02", "p03", "p04", "p05"}:
        state["_peaks"] = peak_components(
            F.col("axis"),
            F.col("y"),
            detect_peaks(F.col("axis"), F.col("y"), range_threshold(F.col("y"))),
        )
    df = df.withColumns(state)
    if "p05" in wanted:
        df = df.withColumn(
            "_centres", false_centres(F.col("signal_id"), F.col("axis"), F.col("_peaks"), seed, strongest=max(alphas))
        )
    # the explode is also the barrier that keeps the state above from being
    # recomputed for every strength
    df = df.withColumn("_c", F.explode(condition_array(perturbations, alphas, identity)))
    df = df.withColumns({"perturbation_id": F.col("_c.perturbation_id"), "alpha": F.col("_c.alpha")})
    p, a, y = F.col("perturbation_id"), F.col("alpha"), F.col("ref_y")

    def add(column, factor):
        return A.lets(
            {"f": factor, "y": y, "s": F.col(column)},
            lambda t: F.zip_with(t["y"], t["s"], lambda u, v: u + t["f"] * v),
        )

    def minus(factor, keep):
        return A.lets(
            {"f": factor, "y": y, "s": removed_components(F.col("_peaks"), keep)},
            lambda t: F.zip_with(t["y"], t["s"], lambda u, v: u - t["f"] * v),
        )

    def weak(q):
        return q["rank"] <= weak_count(a, F.size("_peaks"))

    has_peaks = F.size("_peaks") > 0 if "_peaks" in state else None
    out = {
        "p01": lambda: F.when(has_peaks, minus(a, lambda q: F.lit(True))),
        "p02": lambda: F.when(has_peaks, minus(F.lit(0.5), weak)),
        "p03": lambda: F.when(has_peaks, broadened(F.col("axis"), y, F.col("_peaks"), a)),
        "p04": lambda: F.when(has_peaks, minus(F.lit(1.0), weak)),
        "p05": lambda: F.when(
            has_peaks
            & (F.size("_centres") >= F.floor(F.lit(float(max(alphas))) * F.size("_peaks"))),
            with_false_peaks(F.col("axis"), y, F.col("_peaks"), F.col("_centres"), a),
        ),
        "p06": lambda: add(baseline_col, a),
        "p07": lambda: add(baseline_col, -a),
        "p08": lambda: add("_drift", a * F.col("_rms")),
        "p09": lambda: add("_white", a * F.col("_rms")),
        "p10": lambda: add("_corr", a * F.col("_rms")),
        "p11": lambda: y,
        "p12": lambda: y,
    }
    value = F.when(p == "id", y)
    for name in perturbations:
        value = value.when(p == name, CUSTOM[name](a) if name in CUSTOM else out[name]())
    df = A.pin(df, {"axis": _axis_out(p, a, F.col("ref_axis")), "y": value})
    return df.drop("_c", *state, *(["_centres"] if "p05" in wanted else []))


CUSTOM: dict[str, Callable[[Column], Column]] = {}


def register_perturbation(perturbation_id: str, expression: Callable[[Column], Column]) -> None:
    """Add ``expression(alpha) -> array column`` over ``ref_axis`` and ``ref_y``."""
    CUSTOM[perturbation_id] = expression


def invariants(perturbed: DataFrame) -> DataFrame:
    """One row per cell with the contract flags of a perturbed table."""
    axis_moves = F.col("perturbation_id").isin("p11", "p12")
    increasing = A.let(A.differences("axis"), lambda d: F.forall(d, lambda v: v > 0))
    same_axis = F.col("axis") == F.col("ref_axis")
    same_y = F.col("y") == F.col("ref_y")
    return perturbed.select(
        "signal_id",
        "perturbation_id",
        "alpha",
        F.col("y").isNull().alias("missing"),
        increasing.alias("axis_increasing"),
        F.when(F.col("alpha") == 0, same_axis & same_y)
        .otherwise(F.when(axis_moves, ~same_axis & same_y).otherwise(same_axis & ~same_y))
        .alias("contract_holds"),
        A.rms(F.zip_with("y", "ref_y", lambda u, v: u - v)).alias("y_effect"),
        A.rms(F.zip_with("axis", "ref_axis", lambda u, v: u - v)).alias("axis_effect"),
    )
