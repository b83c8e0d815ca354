"""Perturbed cells of many signals at once: numpy over blocks of signals with one axis.

The column expressions of ``perturb`` and ``measures`` are interpreted once per
element, which at forty cells a signal is most of a run.  The random state stays
an expression; cells, measures and grid values of sound signals (finite values on
an increasing axis) are matrices here, with the same formulas.  Other signals keep
the expressions.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from ..functions.measures import MAD_TO_SIGMA, MEASURES, Pair
from ..functions.peak_counts import match_rows, peak_mask, row_ratios
from . import measure as M
from .perturb import ALPHAS, CORRELATION_LENGTH, MAX_AXIS_CHANGE, SEED, perturb, positive_grid, white_noise

FAMILIES = ("p08", "p09", "p10", "p11", "p12")
#: Signals whose cells are in memory at once; library signals and queries of a product.
BLOCK, LIBRARY_ROWS, QUERY_ROWS = 1024, 8192, 65_536
LARGEST = 1e100  # squares of larger values overflow


def sound(grid: tuple[float, float, int] | None = None) -> Column:
    """Whether a signal has finite values on an increasing axis, and a ``grid`` inside every moved axis."""
    fine = lambda v: v.isNotNull() & (F.abs(v) < LARGEST)
    ok = (F.size("y") >= 2) & (F.size("axis") == F.size("y")) & F.forall("y", fine) & F.forall("axis", fine)
    ok = ok & F.forall(A.differences("axis"), lambda d: d > 0)
    if grid:
        start, step, count = grid
        first, last = F.get("axis", F.lit(0)), F.element_at("axis", -1)
        ok = ok & (first + MAX_AXIS_CHANGE * max(ALPHAS) <= start) & (last >= start + step * (count - 1))
    return F.coalesce(F.when(F.size("y") >= 2, ok), F.lit(False))


def with_state(signals: DataFrame, families=FAMILIES, seed=SEED) -> DataFrame:
    """Signals with the hashed numbers that their cells need: ``_drift``, ``_white``, ``_z``."""
    state: dict[str, Column] = {}
    if "p08" in families:
        degree = 2 + H.draw_index(3, seed, "p08deg", F.col("signal_id"))
        parts = [F.when(degree >= k, H.normal(seed, "p08", F.col("signal_id"), k)).otherwise(0.0) for k in (2, 3, 4)]
        state["_drift"] = F.array(*parts)
    if "p09" in families:
        state["_white"] = white_noise(F.col("signal_id"), F.size("y"), "p09", seed)
    if "p10" in families:
        state["_z"] = white_noise(F.col("signal_id"), F.size("axis"), "p10", seed)
    return signals.withColumns(state) if state else signals


def axis_groups(rows: pa.Table, names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """Row numbers, axis and matrices of the columns ``names`` for each distinct axis."""
    lengths = pc.list_value_length(rows.column("axis")).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        own = rows if len(at) == rows.num_rows else rows.take(pa.array(at))
        full = {c: pc.list_flatten(own.column(c)).to_numpy().reshape(len(at), -1) for c in ("axis", *names)}
        axes = full.pop("axis")
        if (axes == axes[0]).all():
            yield at, axes[0], full
            continue
        distinct, which = np.unique(axes, axis=0, return_inverse=True)
        for g, axis in enumerate(distinct):
            mine = np.flatnonzero(which.ravel() == g)
            yield at[mine], axis, {c: v[mine] for c, v in full.items()}


def _over(values: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Rows divided by their norm; nan where it is not positive."""
    return values / np.where(norm > 0, norm, np.nan)[:, None]


def _rms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1) / v.shape[1])


def _norm(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def _centred(v: np.ndarray) -> np.ndarray:
    return v - v.mean(axis=1, keepdims=True)


def _standardised(v: np.ndarray) -> np.ndarray:
    c = _centred(v)
    return _over(c, _rms(c))


def shapes(axis: np.ndarray, state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What the additive families add at strength 1, times the signal's root mean square."""
    out = {}
    scale = _rms(state["y"])[:, None]
    if "_drift" in state:
        u = -1 + 2 * (axis - axis[0]) / (axis[-1] - axis[0])
        basis = np.stack([(3 * u * u - 1) / 2, (5 * u**3 - 3 * u) / 2, (35 * u**4 - 30 * u * u + 3) / 8])
        out["p08"] = scale * _standardised(state["_drift"] @ basis)
    if "_white" in state:
        out["p09"] = scale * state["_white"]
    if "_z" in state:
        kernel = np.exp(-0.5 * ((axis[:, None] - axis[None, :]) / CORRELATION_LENGTH) ** 2)
        out["p10"] = scale * _standardised(state["_z"] @ (kernel / kernel.sum(axis=1, keepdims=True)).T)
    return out


def cell(axis: np.ndarray, y: np.ndarray, added: dict[str, np.ndarray], perturbation: str, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Axis and values of one condition; the values are ``y`` itself where only the axis moves."""
    if perturbation in added:
        return axis, y + alpha * added[perturbation]
    if perturbation == "p11":
        return axis + MAX_AXIS_CHANGE * alpha, y
    if perturbation == "p12":
        u = (axis - axis[0]) / (axis[-1] - axis[0])
        return axis + MAX_AXIS_CHANGE * alpha * u * u, y
    return axis, y


def resampled(axis: np.ndarray, y: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Piecewise-linear values on a target inside the axis; a node that is hit keeps its value."""
    j = np.searchsorted(axis, target, side="right") - 1
    k = np.minimum(j + 1, len(axis) - 1)
    share = np.where(axis[j] == target, 0.0, (target - axis[j]) / np.where(k > j, axis[k] - axis[j], 1.0))
    return y[:, j] + share * (y[:, k] - y[:, j])


def target_axis(grid: tuple[float, float, int]) -> np.ndarray:
    return grid[0] + grid[1] * np.arange(grid[2])


def grid_vectors(signals: DataFrame, families, grid, expressions: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """``perturbation_id, alpha, v`` and the scalar columns of ``signals``: unit vectors of every cell on ``grid``.

    The identity is the cell ('id', 0).  A signal without a norm has no row.
    ``expressions`` gives the same rows of signals that are not sound.
    """
    keep = [c for c in signals.columns if c not in ("axis", "y")]
    state = [c for f, c in (("p08", "_drift"), ("p09", "_white"), ("p10", "_z")) if f in families]
    cells, target = [("id", 0.0), *positive_grid(families)], target_axis(grid)

    def formed(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for at, axis, own in axis_groups(rows, ["y", *state]) if rows.num_rows else ():
                added = shapes(axis, own)
                for p, a in cells:
                    r = resampled(*cell(axis, own["y"], added, p, a), target)
                    v = _over(r, _norm(r))
                    ok = np.flatnonzero(~np.isnan(v).any(axis=1))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1) * len(target), pa.int32()), pa.array(v[ok].ravel()))
                    part = rows.select(keep).take(pa.array(at[ok]))
                    for name, values in (("perturbation_id", pa.array([p] * len(ok), pa.string())), ("alpha", pa.array([a] * len(ok), pa.float64())), ("v", flat)):
                        part = part.append_column(name, values)
                    yield from part.to_batches()

    types = {f.name: f.dataType.simpleString() for f in signals.schema}
    ddl = ", ".join(f"{c} {types[c]}" for c in keep) + ", perturbation_id string, alpha double, v array<double>"
    fine = sound(grid)
    out = with_state(signals.filter(fine), families).select(*keep, "axis", "y", *state).mapInArrow(formed, ddl)
    return out if expressions is None else out.unionByName(expressions(signals.filter(~fine)).select(*keep, "perturbation_id", "alpha", "v"))


# -- measures: (reference axis, reference, axis, candidate) -> one value per row, nan where undefined


def _mass(axis: np.ndarray, y: np.ndarray) -> np.ndarray:
    i = np.arange(len(axis))
    width = (axis[np.minimum(i + 1, len(axis) - 1)] - axis[np.maximum(i - 1, 0)]) / 2
    m = width * np.maximum(y, 0.0)
    return _over(m, m.sum(axis=1))


def _transport(rx, ry, x, y) -> np.ndarray:
    a, b = _mass(rx, ry), _mass(x, y)
    if rx is x or np.array_equal(rx, x):
        return (np.abs(np.cumsum(b - a, axis=1))[:, :-1] * np.diff(x)).sum(axis=1)
    both = np.concatenate([rx, x])
    order = np.argsort(both, kind="stable")
    f = np.cumsum(np.concatenate([-a, b], axis=1)[:, order], axis=1)
    return (np.abs(f)[:, :-1] * np.diff(both[order])).sum(axis=1)


def _squared(rx, ry, x, y) -> np.ndarray:
    return ((y - ry) ** 2).sum(axis=1)


def _normalised(rx, ry, x, y) -> np.ndarray:
    rr = (ry * ry).sum(axis=1)
    return _squared(rx, ry, x, y) / np.where(rr > 0, rr, np.nan)


def _angle(rx, ry, x, y) -> np.ndarray:
    chord = _norm(_over(ry, _norm(ry)) - _over(y, _norm(y))) / 2
    return 2 * np.arcsin(np.minimum(chord, 1.0))


def _correlation(rx, ry, x, y) -> np.ndarray:
    a, b = _centred(ry), _centred(y)
    n = _norm(a) * _norm(b)
    return np.clip((a * b).sum(axis=1) / np.where(n > 0, n, np.nan), -1.0, 1.0)


def _median(v: np.ndarray) -> np.ndarray:
    s = np.sort(v, axis=1)
    n = s.shape[1]
    return (s[:, (n - 1) // 2] + s[:, n // 2]) / 2


def _structure(rx, ry, x, y) -> np.ndarray:
    if y.shape[1] < 3:
        return np.full(len(y), np.nan)
    d = np.diff(y, axis=1)
    noise = _median(np.abs(d - _median(d)[:, None])) / (MAD_TO_SIGMA * math.sqrt(2.0))
    return _rms(_centred(y)) / np.where(noise > 0, noise, np.nan)


VALUES: dict[str, Callable] = {
    "mse": lambda *p: _squared(*p) / p[1].shape[1],
    "rmse": lambda *p: np.sqrt(_squared(*p) / p[1].shape[1]),
    "mae": lambda *p: np.abs(p[3] - p[1]).sum(axis=1) / p[1].shape[1],
    "nmse": _normalised,
    "sam": _angle,
    "pearson": _correlation,
    "wasserstein_1": _transport,
    "structure_to_noise": _structure,
}


#: Outputs of the peak counts, which a pair forms once.
PEAKS = ("peak_precision", "peak_recall", "peak_f1", "artifact_ratio", "missing_ratio")
TOLERANCE = 2.0

#: (axis, values) -> normalised values, nan where the denominator is not positive: ``signals.normalize``.
FORMS: dict[str, Callable] = {
    "none": lambda x, y: y,
    "max": lambda x, y: _over(y, y.max(axis=1)),
    "area": lambda x, y: _over(y, np.abs(y) @ ((x[np.minimum(np.arange(len(x)) + 1, len(x) - 1)] - x[np.maximum(np.arange(len(x)) - 1, 0)]) / 2)),
    "snv": lambda x, y: _standardised(y),
}


def covers(outputs, families) -> bool:
    return set(outputs) <= {*VALUES, *PEAKS} and set(families) <= set(FAMILIES)


def _harms(axis, state, cells, outputs, grid, relative, forms) -> np.ndarray:
    """Values of every cell, form and output (cells x (forms, outputs) x rows), as harm against the clean signal if ``relative``."""
    added, clean = shapes(axis, state), state["y"]
    target = target_axis(grid) if grid else None

    def formed(x, y):
        x, y = (target, resampled(x, y, target)) if grid else (x, y)
        return {f: (x, FORMS[f](x, y)) for f in forms}

    def measured(pairs, names):
        out = {}
        for f in forms:
            counts = peak_values(f, *pairs[f]) if not set(PEAKS).isdisjoint(names) else {}
            out |= {(f, o): counts[o] if o in PEAKS else VALUES[o](*reference[f], *pairs[f]) for o in names}
        return out

    def peak_values(f, x, y):
        (rx, ry), tops = reference[f], own_peaks.setdefault(f, [])
        if not tops:
            tops.append(peak_mask(ry))
        moved = tops[0] if y is ry else peak_mask(y)
        return row_ratios(tops[0].sum(axis=1), moved.sum(axis=1), match_rows(rx, tops[0], x, moved, TOLERANCE))

    reference, own_peaks = formed(axis, clean), {}
    base = measured(reference, outputs)
    out = np.empty((len(cells), len(base), len(clean)))
    for i, (p, a) in enumerate(cells):
        x, y = cell(axis, clean, added, p, a)
        moved = outputs if grid or y is not clean else [o for o in outputs if o == "wasserstein_1" or o in PEAKS]
        values = base | measured(formed(x, y), moved)
        for j, ((f, o), v) in enumerate(values.items()):
            if relative:
                v = base[f, o] - v if MEASURES[o].direction == "higher" else v - base[f, o]
            out[i, j] = v
    return out


def mean_values(
    signals: DataFrame, cluster: str, outputs, families=FAMILIES, grid=None, relative: bool = True, expressions=None, forms=None
) -> DataFrame:
    """``metric, cluster_id, perturbation_id, alpha, x``: mean of each output over the signals of a cluster.

    ``relative``: harm against the clean signal, else the plain value.  ``grid``:
    both sides of a pair are first put on it.  ``forms``: the same after each of
    these normalisations of both sides, named in a column ``variant``.
    ``expressions(signals)`` gives these columns with ``h`` in place of ``x`` for
    signals that are not sound.
    """
    outputs, cells, forms, named = list(outputs), positive_grid(families), list(forms or ("none",)), forms is not None
    kept = [(f, o) for f in forms for o in outputs]
    kind = signals.schema[cluster].dataType.simpleString()
    ok = sound(grid)
    names = [c for f, c in (("p08", "_drift"), ("p09", "_white"), ("p10", "_z")) if f in families]

    def sums(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            who = pc.dictionary_encode(rows.column("_k"), null_encoding="encode").combine_chunks()
            code, n = who.indices.to_numpy(), len(who.dictionary)
            total = np.zeros((len(cells), len(kept), n))
            count = np.zeros((len(cells), len(kept), n), np.int64)
            with np.errstate(invalid="ignore", divide="ignore"):
                for at, axis, state in axis_groups(rows, ["y", *names]):
                    for i in range(0, len(at), BLOCK):
                        h = _harms(axis, {c: v[i : i + BLOCK] for c, v in state.items()}, cells, outputs, grid, relative, forms)
                        member = np.zeros((h.shape[2], n))
                        member[np.arange(h.shape[2]), code[at[i : i + BLOCK]]] = 1.0
                        there = ~np.isnan(h)
                        total += np.where(there, h, 0.0) @ member
                        count += (there @ member).astype(np.int64)
            c, o, k = (g.ravel() for g in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, pa.int32()), who.dictionary.take(pa.array(k)), pa.array(c, pa.int32()), pa.array(total.ravel()), pa.array(count.ravel())],
                ["_o", "_k", "_c", "total", "n"],
            )

    rows = with_state(signals.filter(ok), families).select(F.col(cluster).alias("_k"), "axis", "y", *names)
    parts = rows.mapInArrow(sums, f"_o int, _k {kind}, _c int, total double, n long")
    keys = [*(["variant"] if named else []), "metric", "cluster_id", "perturbation_id", "alpha"]
    kept_of = F.element_at(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(o).alias("o")) for f, o in kept]), F.col("_o") + 1)
    cell_of = F.element_at(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(a).alias("a")) for p, a in cells]), F.col("_c") + 1)
    parts = parts.groupBy("_o", "_k", "_c").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).select(
        *([kept_of["f"].alias("variant")] if named else []), kept_of["o"].alias("metric"),
        F.col("_k").alias("cluster_id"), cell_of["p"].alias("perturbation_id"), cell_of["a"].alias("alpha"), "total", "n",
    )
    rest = signals.filter(~ok)
    if not rest.isEmpty():
        long = (expressions or (lambda s: expressed(s, cluster, outputs, families)))(rest)
        parts = parts.unionByName(long.groupBy(*keys).agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("total"), F.count("h").alias("n")))
    return parts.groupBy(*keys).agg((F.when(F.sum("n") > 0, F.sum("total") / F.sum("n"))).alias("x"))


def expressed(signals: DataFrame, cluster: str, outputs, families) -> DataFrame:
    """Harm of every signal, condition and output by column expressions."""
    long = M.measure_vector(perturb(M.self_values(signals, outputs), families, identity=False), outputs)
    harm = M.oriented(F.col("output_id"), F.col("base")[F.col("output_id")], F.col("value"))
    return long.select(F.col("output_id").alias("metric"), F.col(cluster).alias("cluster_id"), "perturbation_id", "alpha", harm.alias("h"))


# -- identification against a library that is perturbed where it lies --------------------


def moved_library_scores(
    queries: DataFrame, library: DataFrame, ready: DataFrame | None, families, grid, adapted: bool, sizes: tuple[int, int], digits: int
) -> DataFrame:
    """Best cosine per query and class: ``seed, signal_id, true_class, perturbation_id, alpha, class_id, score``.

    ``queries``: these keys and the unit vector ``v``.  ``library``: signal_id,
    class_id, seeds (those of whose library it is a member), axis, y and, if
    ``adapted``, the state of its cells; its vectors are formed in the task that
    compares them and never move.  ``ready``: signal_id, class_id, seeds,
    perturbation_id, alpha, v of members that are not sound.  ``sizes``: rows of
    the library and of the queries.
    """
    key = ["seed", "signal_id", "true_class", "perturbation_id", "alpha"]
    states = [c for c in ("_drift", "_white", "_z") if c in library.columns]
    cores = library.sparkSession.sparkContext.defaultParallelism
    nl = max(1, -(-sizes[0] // LIBRARY_ROWS), min(cores, sizes[0] // 256))
    nq = max(1, -(-sizes[1] // QUERY_ROWS))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select(*key, "v").withColumn("_q", F.pmod(F.xxhash64(*key), F.lit(nq)).cast("int")).withColumn("_l", every(nl))
    own = ["signal_id", "class_id", "seeds", "axis", "y", *states]
    lib = library.select(*own).withColumns({c: F.lit(None).cast(t) for c, t in (("perturbation_id", "string"), ("alpha", "double"), ("v", "array<double>"))})
    if ready is not None:
        lib = lib.unionByName(ready.select("signal_id", "class_id", "seeds", "perturbation_id", "alpha", "v"), allowMissingColumns=True)
    lib = lib.withColumn("_l", F.pmod(F.xxhash64("signal_id"), F.lit(nl)).cast("int")).withColumn("_q", every(nq))
    # the library side gets names of its own: both sides may stem from one table
    lib = lib.select(*[F.col(c).alias(f"r_{c}") for c in lib.columns])
    target = target_axis(grid)
    types = {f.name: f.dataType.simpleString() for f in queries.schema}
    ddl = ", ".join(f"{c} {types[c]}" for c in key) + f", class_id {library.schema['class_id'].dataType.simpleString()}, score double"

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        right = right.rename_columns([c.removeprefix("r_") for c in right.column_names]).sort_by("class_id").combine_chunks()
        chosen, classes, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            vectors = pc.list_flatten(left.column("v")).to_numpy().reshape(left.num_rows, -1)
            asked = list(zip(left.column("perturbation_id").to_pylist(), left.column("alpha").to_pylist()))
            by_cell: dict[tuple, dict[int, list[int]]] = {}
            for i, (c, s) in enumerate(zip(asked, left.column("seed").to_pylist())):
                by_cell.setdefault(c, {}).setdefault(s, []).append(i)
            column = right.column("class_id").combine_chunks()
            code = pc.dictionary_encode(column).combine_chunks() if isinstance(column, pa.ChunkedArray) else column.dictionary_encode()
            first = np.flatnonzero(np.append(True, np.diff(code.indices.to_numpy()) != 0))
            group = np.cumsum(np.isin(np.arange(right.num_rows), first)) - 1
            at = np.repeat(np.arange(right.num_rows), pc.list_value_length(right.column("seeds")).to_numpy())
            seeds = pc.list_flatten(right.column("seeds")).to_numpy()
            given = pc.is_valid(right.column("v")).to_numpy()
            raw = np.flatnonzero(~given)
            parts = []
            for rows, axis, state in axis_groups(right.take(pa.array(raw)), ["y", *states]) if len(raw) else ():
                parts.append((raw[rows], axis, state["y"], shapes(axis, state) if states else {}))
            fixed = None
            for c, per_seed in by_cell.items():
                if adapted or fixed is None:
                    v = np.full((right.num_rows, len(target)), np.nan)
                    for rows, axis, y, added in parts:
                        r = resampled(*cell(axis, y, added, *(c if adapted else ("id", 0.0))), target)
                        v[rows] = _over(r, _norm(r))
                    if given.any():
                        same = pc.and_(pc.equal(right.column("perturbation_id"), c[0] if adapted else "id"), pc.equal(right.column("alpha"), c[1] if adapted else 0.0))
                        for i in np.flatnonzero(pc.fill_null(same, False).to_numpy()):
                            v[i] = right.column("v")[int(i)].as_py()
                    fixed = (v, ~np.isnan(v).any(axis=1))
                v, valid = fixed
                for s, rows in per_seed.items():
                    member = np.zeros(right.num_rows, bool)
                    member[at[seeds == s]] = True
                    use = np.flatnonzero(member & valid)
                    if not len(use):
                        continue
                    starts = np.flatnonzero(np.append(True, np.diff(group[use]) != 0))
                    rows = np.array(rows)
                    for i in range(0, len(rows), BLOCK):
                        mine = rows[i : i + BLOCK]
                        top = np.maximum.reduceat(np.clip(vectors[mine] @ v[use].T, -1.0, 1.0), starts, axis=1)
                        chosen.append(np.repeat(mine, len(starts)))
                        classes.append(np.tile(use[starts], len(mine)))
                        best.append(np.round(top, digits).ravel())
        picked = left.select(key).take(pa.array(np.concatenate(chosen)))
        return picked.append_column("class_id", right.column("class_id").take(pa.array(np.concatenate(classes)))).append_column("score", pa.array(np.concatenate(best)))

    out = q.groupBy("_l", "_q").cogroup(lib.groupBy("r__l", "r__q")).applyInArrow(scored, ddl)
    return out.groupBy(*key, "class_id").agg(F.max("score").alias("score"))
