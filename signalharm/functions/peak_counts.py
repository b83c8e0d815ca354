"""Peak counts of signal pairs in Arrow batches: linear-time prominence with a monotone stack.

The column expressions of ``peaks`` give whole peak tables; where only counts of
peaks and matches are needed for many pairs, this is a hundred times faster.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .peaks import ratios

FRACTION = 0.05
COUNTS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("n_ref", "n_cand", "n_match")])


def base_minima(y: list[float]) -> list[float]:
    """For each sample the least value back to the nearest higher sample before it."""
    out, values, lows = [], [], []
    for v in y:
        low = v
        while values and values[-1] <= v:
            values.pop()
            low = min(low, lows.pop())
        values.append(v)
        lows.append(low)
        out.append(low)
    return out


def peak_positions(x: np.ndarray, y: np.ndarray, fraction: float = FRACTION) -> list[float]:
    """Positions of strict local maxima whose prominence reaches ``fraction`` of the range."""
    if len(y) < 3:
        return []
    maxima = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:])) + 1
    if len(maxima) == 0:
        return []
    values = y.tolist()
    left, right = base_minima(values), base_minima(values[::-1])[::-1]
    least = fraction * (float(y.max()) - float(y.min()))
    return [float(x[i]) for i in maxima.tolist() if values[i] - max(left[i], right[i]) >= least]


def matches(ref: list[float], cand: list[float], tolerance: float) -> int:
    """One-to-one matches in order of (distance, reference, candidate)."""
    pairs, first = [], 0
    for i, p in enumerate(ref):
        while first < len(cand) and cand[first] < p - tolerance - 1e-9 * abs(p):
            first += 1
        for j in range(first, len(cand)):
            d = abs(cand[j] - p)
            if d <= tolerance:
                pairs.append((d, i, j))
            elif cand[j] > p:
                break
    left, right = set(), set()
    for _, i, j in sorted(pairs):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
    return len(left)


def peak_mask(y: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Where the rows of a matrix have the peaks of :func:`peak_positions`."""
    mask = np.zeros(y.shape, bool)
    if y.shape[1] < 3:
        return mask
    mask[:, 1:-1] = (y[:, 1:-1] > y[:, :-2]) & (y[:, 1:-1] > y[:, 2:])
    row, at = np.nonzero(mask)
    height = y[row, at]
    base = np.maximum(_row_minima(y, row, at, height), _row_minima(y[:, ::-1], row, y.shape[1] - 1 - at, height))
    least = fraction * (y.max(axis=1) - y.min(axis=1))
    mask[row, at] = height - base >= least[row]
    return mask


def _row_minima(y: np.ndarray, row: np.ndarray, at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Least value of a row back to the nearest value above ``height`` before ``at``, by windows of doubled length."""
    high, low = [y], [y]
    while 2 ** len(high) < y.shape[1]:
        k = 2 ** (len(high) - 1)
        for tables, pick in ((high, np.maximum), (low, np.minimum)):
            longer = tables[-1].copy()
            pick(tables[-1][:, k:], tables[-1][:, :-k], out=longer[:, k:])
            tables.append(longer)
    left, least = at.copy(), height.copy()  # nodes not yet passed lie before ``left``
    for k in range(len(high) - 1, -1, -1):
        last = np.maximum(left - 1, 0)
        inside = (left >= 2**k) & (high[k][row, last] <= height)
        least = np.where(inside, np.minimum(least, low[k][row, last]), least)
        left = np.where(inside, left - 2**k, left)
    return least


def match_rows(rx: np.ndarray, ref: np.ndarray, x: np.ndarray, cand: np.ndarray, tolerance: float) -> np.ndarray:
    """Number of :func:`matches` in each row of two peak masks over the axes ``rx`` and ``x``."""
    row, i = np.nonzero(ref)
    j = np.nonzero(cand)[1]
    slack = tolerance + 1e-9 * (np.abs(rx) + tolerance)  # distances decide below
    before = np.append(0, np.cumsum(cand.ravel()))  # candidates before each node, over all rows
    first = before[row * len(x) + np.searchsorted(x, rx - slack)[i]]
    n = before[row * len(x) + np.searchsorted(x, rx + slack, side="right")[i]] - first
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(len(a)) + np.repeat(first - np.append(0, np.cumsum(n))[:-1], n)
    d = np.abs(x[j[b]] - rx[i[a]])
    near = d <= tolerance
    a, b = a[near], b[near]
    order = np.lexsort((b, a, d[near]))  # rows do not meet: one order serves all
    left, right, found = bytearray(len(row)), bytearray(len(j)), []
    for p, q in zip(a[order].tolist(), b[order].tolist()):
        if not (left[p] or right[q]):
            left[p] = right[q] = 1
            found.append(p)
    return np.bincount(row[found], minlength=len(ref))


def row_ratios(n_ref: np.ndarray, n_cand: np.ndarray, n_match: np.ndarray) -> dict[str, np.ndarray]:
    """``peaks.ratios`` of counts in arrays."""

    def share(value, of, empty):
        return np.where(of == 0, empty, value / np.where(of == 0, 1, of))

    return {
        "peak_precision": share(n_match, n_cand, 1.0),
        "peak_recall": share(n_match, n_ref, 1.0),
        "peak_f1": share(2.0 * n_match, n_ref + n_cand, 1.0),
        "artifact_ratio": share(n_cand - n_match, n_cand, 0.0),
        "missing_ratio": share(n_ref - n_match, n_ref, 0.0),
    }


@F.pandas_udf(COUNTS)
def _counts(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for batch in parts:
        rows = []
        for rx, ry, x, y, tolerance in zip(*batch):
            if any(v is None for v in (rx, ry, x, y)) or any(np.isnan(v.astype(float)).any() for v in (ry, y)):
                rows.append((None, None, None))
                continue
            a, b = peak_positions(rx, ry), peak_positions(x, y)
            rows.append((len(a), len(b), matches(a, b, tolerance)))
        yield pd.DataFrame(rows, columns=["n_ref", "n_cand", "n_match"]).astype("Int32")


def peak_outputs(pair, tolerance: float = 2.0) -> Column:
    """Counts of both sides and of matches of a pair; :func:`peak_ratio` reads an output from them."""
    return _counts(*[c.cast("array<double>") for c in (pair.ref_axis, pair.ref_y, pair.axis, pair.y)], F.lit(float(tolerance)))


def peak_ratio(name: str):
    return lambda b: ratios(b["n_ref"], b["n_cand"], b["n_match"])[name]
