"""Peak tables, one-to-one matches and mechanism endpoints of sound signals in Arrow batches.

``functions.peaks``, ``perturb`` (p01 to p05) and ``mechanism`` state the same as column
expressions, which look at every pair of nodes of a signal and are interpreted once per
element.  Here a prominence takes a stack over the local maxima, so the work grows with
the length of a signal.  Signals that are not ``blocks.sound`` keep the expressions.
"""

import hashlib
import math
from bisect import bisect, insort
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.peak_counts import FRACTION
from . import perturb as P
from .blocks import axis_groups, cell, shapes, sound, with_state

#: Signals whose cells are in memory at once.
BLOCK = 512
NO_EVENTS = "not_applicable_zero_synthetic_events"
RATIOS = ("peak_precision", "peak_recall", "peak_f1", "artifact_ratio", "missing_ratio")
ERRORS = ("position_error", "relative_height_error", "fwhm_error", "area_error")


class Peaks:
    """Strict local maxima of at least ``FRACTION`` of the range: 0-based node, position, prominence, higher base."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.idx, self.prom, self.contour = _prominent(y)
        self.pos = x[self.idx].tolist()

    def _down(self, i: int, level: float, step: int) -> int:
        """Nearest node before or after a peak that is at ``level`` or below."""
        y, j = self.y, i + step
        while y[j] > level:
            j += step
        return j

    def _crossing(self, level: float, lower: int, upper: int) -> float:
        x, y = self.x, self.y
        return x[lower] + (level - y[lower]) / (y[upper] - y[lower]) * (x[upper] - x[lower])

    def fwhm(self) -> list[float]:
        out = []
        for i, prom in zip(self.idx, self.prom):
            half = self.y[i] - 0.5 * prom
            l, r = self._down(i, half, -1), self._down(i, half, 1)
            out.append(float(self._crossing(half, r, r - 1) - self._crossing(half, l, l + 1)))
        return out

    def area(self) -> list[float]:
        """Area above the higher base."""
        x, y, out = self.x, self.y, []
        for i, base in zip(self.idx, self.contour):
            l, r = self._down(i, base, -1), self._down(i, base, 1)
            xs = np.concatenate([[self._crossing(base, l, l + 1)], x[l + 1 : r], [self._crossing(base, r, r - 1)]])
            over = np.concatenate([[0.0], y[l + 1 : r] - base, [0.0]])
            out.append(float((np.diff(xs) * (over[1:] + over[:-1])).sum() / 2))
        return out


def _prominent(y: np.ndarray) -> tuple[list[int], list[float], list[float]]:
    if len(y) < 3:
        return [], [], []
    up, down = np.empty(len(y), bool), np.empty(len(y), bool)
    up[0] = down[-1] = True
    np.greater_equal(y[1:], y[:-1], out=up[1:])
    np.greater_equal(y[:-1], y[1:], out=down[:-1])
    # maxima, ends and flat tops among them: the nearest higher node of a peak lies on the slope of the nearest higher one
    tops = np.flatnonzero(up & down)
    at, height = tops.tolist(), y[tops].tolist()
    lows = np.minimum.reduceat(y, np.append(0, tops)).tolist()  # least before each top, and after the last
    if tops[0] == 0:
        lows[0] = height[0]
    left = _bases(height, lows[:-1])
    right = _bases(height[::-1], lows[:0:-1])[::-1]
    least = FRACTION * (float(y.max()) - float(y.min()))
    idx, prom, contour = [], [], []
    for i, h, a, b in zip(at, height, left, right):
        if 0 < i < len(y) - 1 and y[i - 1] < h > y[i + 1]:
            base = a if a > b else b
            if h - base >= least:
                idx.append(i)
                prom.append(h - base)
                contour.append(base)
    return idx, prom, contour


def _bases(height: list[float], lows: list[float]) -> list[float]:
    """For each top the least value back to the nearest higher one; ``lows``: least since the top before."""
    out, tops, least = [], [], []
    for h, low in zip(height, lows):
        if h < low:
            low = h
        while tops and tops[-1] <= h:
            tops.pop()
            v = least.pop()
            if v < low:
                low = v
        tops.append(h)
        least.append(low)
        out.append(low)
    return out


def match(ref: list[float], cand: list[float], tolerance: float) -> list[tuple[float, int, int]]:
    """One-to-one matches of ordered positions in order of (distance, reference, candidate)."""
    pairs, first, n = [], 0, len(cand)
    for i, p in enumerate(ref):
        while first < n and cand[first] < p and p - cand[first] > tolerance:
            first += 1
        for j in range(first, n):
            d = abs(cand[j] - p)
            if d <= tolerance:
                pairs.append((d, i, j))
            elif cand[j] > p:
                break
    pairs.sort()
    left, right, out = set(), set(), []
    for m in pairs:
        if m[1] not in left and m[2] not in right:
            left.add(m[1])
            right.add(m[2])
            out.append(m)
    return out


def _blocks(batches) -> Iterator[pa.Table]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            yield pa.Table.from_batches([batch.slice(i, BLOCK)])


# -- cells of the peak family --------------------------------------------------------------


def _median(values: list[float]) -> float:
    s = sorted(values)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def false_centres(key: str, x: np.ndarray, pos: list[float], radius: float, wanted: int) -> list[float]:
    """``perturb.false_centres``; ends early where every later proposal would fall near a peak or a centre."""
    lo, hi, out, taken = float(x[0]), float(x[-1]), [], sorted(pos)
    margin = 1e-9 * (abs(lo) + abs(hi) + radius)

    def room() -> bool:
        end = lo
        for q in taken:
            if q - radius + margin > end:
                return True
            end = max(end, q + radius - margin)
        return end <= hi

    k = 0
    while len(out) < wanted and k < P.PROPOSAL_LIMIT:
        if k % 64 == 0 and not room():
            break
        u = int(hashlib.md5(f"{key}{k}".encode()).hexdigest()[:13], 16) / 2**52
        c, k = lo + (hi - lo) * u, k + 1
        i = bisect(taken, c)
        if all(abs(c - q) >= radius for q in taken[max(i - 1, 0) : i + 1]):
            out.append(c)
            insort(taken, c)
            if not room():
                break
    return out


def _components(own: Peaks) -> tuple[np.ndarray, list[float], list[float]]:
    """Component of each peak above the chord of its support (peaks x nodes); first and last node of the supports."""
    x, y, idx = own.x, own.y, own.idx
    between = [(a + b + 2) // 2 - 1 for a, b in zip(idx, idx[1:])]  # midpoints count nodes from 1
    lows, highs = [0, *between], [*between, len(y) - 1]
    parts = np.zeros((len(idx), len(y)))
    for k, (lo, hi) in enumerate(zip(lows, highs)):
        chord = y[lo] + (x[lo : hi + 1] - x[lo]) / (x[hi] - x[lo]) * (y[hi] - y[lo])
        parts[k, lo : hi + 1] = np.maximum(y[lo : hi + 1] - chord, 0.0)
    return parts, x[lows].tolist(), x[highs].tolist()


def peak_cells(x: np.ndarray, y: np.ndarray, own: Peaks, key: str, alphas) -> Iterator[tuple[str, float, np.ndarray, list, list[float]]]:
    """Perturbation, strength, values, supports (p02) and events (p04, p05) of every cell of a signal with peaks."""
    n, width = len(own.idx), own.fwhm()
    parts, lows, highs = _components(own)
    w = (x[np.minimum(np.arange(len(x)) + 1, len(x) - 1)] - x[np.maximum(np.arange(len(x)) - 1, 0)]) / 2
    # at a node that two supports share the later component counts
    tiles = parts.copy()
    for k in range(n - 1):
        tiles[k, np.searchsorted(x, highs[k])] = 0.0
    whole, areas = tiles.sum(axis=0), parts @ w
    order = sorted(range(n), key=lambda k: (own.prom[k], own.pos[k], own.idx[k]))
    middle = _median(width)
    height = _median([float(parts[k, i]) for k, i in enumerate(own.idx)])
    centres = false_centres(key, x, own.pos, 2.0 * middle, math.floor(max(alphas) * n))
    away = (x[None, :] - np.array(own.pos)[:, None]) ** 2
    sigma = P.SIGMA_PER_FWHM * middle
    false = np.exp(-0.5 * ((x[None, :] - np.array(centres).reshape(-1, 1)) / sigma) ** 2)
    for a in alphas:
        if a <= 0:
            continue
        weak = sorted(order[: min(math.ceil(a * n), n)])
        lost = tiles[weak].sum(axis=0)
        yield "p01", a, y - a * whole, [], []
        yield "p02", a, y - 0.5 * lost, [(lows[k], highs[k]) for k in weak], []
        g = np.exp(-0.5 * away / (a * middle) ** 2)
        yield "p03", a, (y - whole) + (areas / (g @ w)) @ g, [], []
        yield "p04", a, y - lost, [], [own.pos[k] for k in weak]
        if len(centres) >= math.floor(max(alphas) * n):
            used = math.floor(a * n)
            yield "p05", a, y + height * false[:used].sum(axis=0), [], sorted(centres[:used])


def _without(positions: list[float], gone: set[int]) -> list[float]:
    return [p for i, p in enumerate(positions) if i not in gone]


def _endpoints(p: str, own: Peaks, width: list[float], cand: Peaks, supports, events, tolerance: float) -> list[tuple]:
    """endpoint, numerator, denominator, reason of an empty denominator: those of ``mechanism.endpoints``."""
    base, moved = own.pos, cand.pos
    if p in ("p01", "p02", "p03"):
        hits = match(base, moved, tolerance)
    if p == "p01":
        return [("p01_retention", len(hits), len(base), "no_baseline_peaks")]
    if p == "p02":
        inside = {i for i, q in enumerate(base) if any(lo <= q <= hi for lo, hi in supports)}
        kept = sum(m[1] in inside for m in hits)
        return [
            ("p02_affected_retention", kept, len(inside), "no_affected_baseline_peaks"),
            ("p02_unaffected_retention", len(hits) - kept, len(base) - len(inside), "no_unaffected_baseline_peaks"),
        ]
    if p == "p03":
        after = cand.fwhm() if hits else []
        return [
            ("p03_retention", len(hits), len(base), "no_baseline_peaks"),
            ("p03_position_mae", sum(m[0] for m in hits), len(hits), "no_matched_baseline_peaks"),
            ("p03_log2_fwhm_ratio", sum(math.log2(after[r] / width[l]) for _, l, r in hits), len(hits), "no_matched_baseline_peaks"),
        ]
    before = match(events, base, tolerance)
    rest = _without(base, {m[2] for m in before})
    if p == "p04":
        known = {m[1] for m in before}
        still = match([e for i, e in enumerate(events) if i in known], moved, tolerance)
        kept = match(rest, _without(moved, {m[2] for m in still}), tolerance)
        return [
            ("p04_disappearance", len(before) - len(still), len(before), "no_baseline_matched_deleted_event"),
            ("p04_undeleted_retention", len(kept), len(rest), "no_undeleted_baseline_peaks"),
        ]
    if not events:
        return [("p05_detection_gain", None, 0, NO_EVENTS), ("p05_native_retention", None, 0, NO_EVENTS)]
    found = match(events, moved, tolerance)
    kept = match(rest, _without(moved, {m[2] for m in found}), tolerance)
    return [
        ("p05_detection_gain", len(found) - len(before), len(events), NO_EVENTS),
        ("p05_native_retention", len(kept), len(rest), "no_native_baseline_peaks"),
    ]


COLUMNS = {
    "perturbation_id": "string", "alpha": "double", "endpoint_id": "string", "numerator": "double", "denominator": "long",
    "value": "double", "state": "string", "reason_code": "string",
}


def mechanism_rows(signals: DataFrame, alphas=P.ALPHAS, tolerance: float = 2.0) -> DataFrame:
    """``mechanism.endpoints`` of every p01 to p05 cell of sound ``signals``, after their scalar columns."""
    keep = [c for c in signals.columns if c not in ("axis", "y")]
    types = {f.name: f.dataType.simpleString() for f in signals.schema}

    def run(batches):
        for rows in _blocks(batches):
            key = rows.column("_key").to_pylist()
            at, cells = [], []
            for mine, axis, own in axis_groups(rows, ["y"]):
                for i, y in zip(mine.tolist(), own["y"]):
                    peaks = Peaks(axis, y)
                    if not peaks.idx:
                        continue
                    width = peaks.fwhm()
                    for p, a, moved, supports, events in peak_cells(axis, y, peaks, key[i], alphas):
                        for name, top, below, reason in _endpoints(p, peaks, width, Peaks(axis, moved), supports, events, tolerance):
                            at.append(i)
                            if below:
                                cells.append((p, a, name, float(top), below, top / below, "complete_numeric", ""))
                            else:
                                state = NO_EVENTS if reason == NO_EVENTS else "complete_empty_risk_set"
                                cells.append((p, a, name, 0.0, 0, None, state, reason))
            part = rows.select(keep).take(pa.array(at, pa.int64()))
            for (name, kind), column in zip(COLUMNS.items(), zip(*cells) if cells else [()] * len(COLUMNS)):
                part = part.append_column(name, pa.array(column, {"long": pa.int64(), "double": pa.float64()}.get(kind, pa.string())))
            yield from part.to_batches()

    seeded = F.concat(F.concat_ws("|", F.lit(str(P.SEED)), F.lit("p05"), F.col("signal_id")), F.lit("|"))
    ddl = ", ".join([f"{c} {types[c]}" for c in keep] + [f"{n} {k}" for n, k in COLUMNS.items()])
    return signals.filter(sound()).withColumn("_key", seeded).mapInArrow(run, ddl)


# -- cells of the additive and axis families -----------------------------------------------


def _pairs(batches, families):
    """For every block of signals: the cells, and per cell the reference and candidate peaks of its signals."""
    names = [c for f, c in (("p08", "_drift"), ("p09", "_white"), ("p10", "_z")) if f in families]
    grid = P.positive_grid(families)
    for rows in _blocks(batches):
        for _, axis, own in axis_groups(rows, ["y", *names]):
            added = shapes(axis, own)
            ref = [Peaks(axis, y) for y in own["y"]]
            for p, a in grid:
                x, moved = cell(axis, own["y"], added, p, a)
                yield p, a, ref, (Peaks(x, y) for y in moved)


def _with_state(signals: DataFrame, families) -> DataFrame:
    names = [c for f, c in (("p08", "_drift"), ("p09", "_white"), ("p10", "_z")) if f in families]
    return with_state(signals.filter(sound()), families).select("axis", "y", *names)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n == "perturbation_id" else pa.int64() if n.startswith("n_") else pa.float64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for k, c in zip(kinds, zip(*rows))], names)


def scan_sums(signals: DataFrame, families, tolerances, cuts) -> DataFrame:
    """Matches and sums of the peak ratios of sound signals: parts of each (tolerance, cut, cell), each with its count ``n_cells``."""
    names = ["tolerance", "min_prominence", "perturbation_id", "alpha", "n_cells", "n_match", *RATIOS]
    settings = list(product(tolerances, cuts))

    def run(batches):
        for p, a, ref, moved in _pairs(batches, families):
            sums = np.zeros((len(settings), 2 + len(RATIOS)))
            for own, cand in zip(ref, moved):
                hits = {}
                for c in cuts:
                    left, right = ([q for q, prom in zip(s.pos, s.prom) if prom >= c] for s in (own, cand))
                    size = len(left), len(right)
                    if size not in hits:  # a higher cut that takes nothing changes nothing
                        # matches are settled by growing distance: those of a smaller tolerance come first
                        hits[size] = [m[0] for m in match(left, right, max(tolerances))]
                    hits[c] = *size, hits[size]
                for k, (t, c) in enumerate(settings):
                    l, r, far = hits[c]
                    m = bisect(far, t)
                    f1 = 2.0 * m / (l + r) if l + r else 1.0
                    sums[k] += (1, m, m / r if r else 1.0, m / l if l else 1.0, f1, (r - m) / r if r else 0.0, (l - m) / l if l else 0.0)
            yield _table([(*s, p, a, int(v[0]), int(v[1]), *v[2:]) for s, v in zip(settings, sums)], names)

    ddl = "tolerance double, min_prominence double, perturbation_id string, alpha double, n_cells long, n_match long, " + ", ".join(f"{r} double" for r in RATIOS)
    return _with_state(signals, families).mapInArrow(run, ddl)


def error_sums(signals: DataFrame, families, tolerance: float = 2.0) -> DataFrame:
    """Sums of the mean errors of matched peaks over sound signals, with the counts of defined ones (``n_`` and the name)."""
    names = ["perturbation_id", "alpha", *[f"n_{e}" for e in ERRORS], *ERRORS]

    def run(batches):
        for p, a, ref, moved in _pairs(batches, families):
            count, total = [0] * 4, [0.0] * 4
            for own, cand in zip(ref, moved):
                hits = match(own.pos, cand.pos, tolerance)
                if not hits:
                    continue
                h0, h1, w0, w1, a0, a1 = own.y, cand.y, own.fwhm(), cand.fwhm(), own.area(), cand.area()
                height = [(float(h0[own.idx[l]]), float(h1[cand.idx[r]])) for _, l, r in hits]
                errors = (
                    [m[0] for m in hits],
                    [abs(v - u) / abs(u) if u else None for u, v in height],
                    [abs(w1[r] - w0[l]) for _, l, r in hits],
                    [abs(a1[r] - a0[l]) for _, l, r in hits],
                )
                for k, e in enumerate(errors):
                    if None not in e:
                        count[k] += 1
                        total[k] += sum(e) / len(e)
            yield _table([(p, a, *count, *total)], names)

    ddl = "perturbation_id string, alpha double, " + ", ".join(f"n_{e} long" for e in ERRORS) + ", " + ", ".join(f"{e} double" for e in ERRORS)
    return _with_state(signals, families).mapInArrow(run, ddl)
