"""Counting inversions and selecting slopes, for rows of numbers in numpy.

An inversion is a pair of places i < j with ``v[i] > v[j]``. The places are sorted by value, then split by their
bits from the highest down, as a wavelet tree does: two places part at their highest differing bit, and there one
running sum counts the larger values to the left. That is n log n, whole matrices at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _splits(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bit, from the highest down: ``places``, in nodes that share the higher bits and by value within; which of
    them have the bit; and where each one's node ends."""
    n = places.shape[1]
    for bit in range((n - 1).bit_length() - 1, -1, -1):
        right = (places >> bit) & 1 == 1
        start = (places >> (bit + 1)) << (bit + 1)
        end = np.minimum(start + (2 << bit), n)
        yield places, right, end
        # stable partition of every node by this bit; a node lies where its places begin
        left_before = np.cumsum(~right, axis=1) - ~right
        left_of_node = left_before - np.take_along_axis(left_before, start, axis=1)
        here = np.arange(n)[None, :] - start
        to = start + np.where(right, np.minimum(1 << bit, n - start) + here - left_of_node, left_of_node)
        parted = np.empty_like(places)
        np.put_along_axis(parted, to, places, axis=1)
        places = parted


def inversions(v: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Inversions of each row of ``v``; with ``weights``, the sum of both places' products."""
    places = np.argsort(v, axis=1, kind="stable")
    total = np.zeros(len(v))
    zero = np.zeros((len(v), 1))
    for at, right, end in _splits(places):
        w = np.ones(at.shape) if weights is None else np.take_along_axis(weights, at, axis=1)
        left = np.concatenate([zero, np.cumsum(np.where(right, 0.0, w), axis=1)], axis=1)
        above = np.take_along_axis(left, end, axis=1) - left[:, 1:]
        total += np.where(right, above * w, 0.0).sum(axis=1)
    return total


class _Crossings:
    """Inversions of one row, to be drawn from or listed: for every bit, each place that has it sees a range of larger ones."""

    def __init__(self, v: np.ndarray):
        self.later, self.lefts, first, count, offset = [], [], [], [], 0
        for at, right, end in _splits(np.argsort(v, kind="stable")[None, :]):
            at, right, end = at[0], right[0], end[0]
            left = np.concatenate([[0], np.cumsum(~right)])
            self.later.append(at[right])
            first.append(left[1:][right] + offset)
            count.append((left[end] - left[1:])[right])
            self.lefts.append(at[~right])
            offset += len(self.lefts[-1])
        none = [np.zeros(0, np.int64)]
        self.later, self.lefts = np.concatenate(self.later or none), np.concatenate(self.lefts or none)
        self.first = np.concatenate(first or none)
        self.ends = np.cumsum(np.concatenate(count or none))
        self.total = int(self.ends[-1]) if len(self.ends) else 0

    def pairs(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places (earlier, later) of the inversions with these numbers, out of ``total``."""
        k = np.searchsorted(self.ends, numbers, "right")
        within = numbers - np.where(k > 0, self.ends[k - 1], 0)
        return self.lefts[self.first[k] + within], self.later[k]


# slopes, per value of a series, that are listed to select among
LISTED = 64
_DRAWN = 4096


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """Median of the slopes of all pairs; ``x`` ascending and distinct. n log n in time, linear in memory.

    NaN for fewer than two values, and where a value is not finite. Slopes that agree up to rounding are one value.
    """
    n = len(x)
    pairs = n * (n - 1) // 2
    if pairs == 0 or not np.isfinite(y).all():
        return np.nan
    x, y = x - x[n // 2], y - y[n // 2]
    middle = sorted({(pairs - 1) // 2, pairs // 2})
    return sum(_slope_of_rank(x, y, k, np.random.default_rng(n)) for k in middle) / len(middle)


def _slope_of_rank(x: np.ndarray, y: np.ndarray, k: int, rng: np.random.Generator) -> float:
    """The slope with ``k`` others before it.

    The slopes between two bounds are the pairs whose order by ``y - bound * x`` differs. Slopes drawn at random from
    them, a little below and above the wanted rank, cut off what lies beyond, until few enough are left to be listed.
    A cut leaves out its own slope too, so every round is narrower.
    """
    n = len(x)
    # relative rounding of y - t * x, as an error of the slope
    least = np.finfo(float).tiny
    fuzz = lambda t: least + 8 * np.finfo(float).eps * (np.abs(y).max() + abs(t) * np.abs(x).max()) / np.diff(x).min()
    below = lambda t: int(inversions((y - t * x)[None, :])[0])
    low, high, under, upto = -np.inf, np.inf, 0, n * (n - 1) // 2

    def between(numbers: np.ndarray | None) -> np.ndarray:
        """Slopes between the bounds: those with these numbers, or all."""
        order = np.arange(n) if low == -np.inf else np.argsort(y - low * x, kind="stable")
        # at the upper end every later value comes first
        at_high = np.argsort(np.argsort(y - high * x, kind="stable")) if high < np.inf else np.arange(n)[::-1]
        crossings = _Crossings(at_high[order])
        i, j = crossings.pairs(np.arange(crossings.total) if numbers is None else (numbers * crossings.total).astype(np.int64))
        i, j = order[i], order[j]
        return np.sort((y[j] - y[i]) / (x[j] - x[i]))

    while upto - under > LISTED * n:
        drawn = between(rng.random(_DRAWN))
        inside, at = upto - under, (k - under) / (upto - under) * _DRAWN
        for v in (drawn[int(max(at - 3 * _DRAWN**0.5, 0))], drawn[int(min(at + 3 * _DRAWN**0.5, _DRAWN - 1))]):
            if not low < v < high:
                continue
            lo, hi = max(v - fuzz(v), low), min(v + fuzz(v), high)
            under_lo, under_hi = under if lo == low else below(lo), upto if hi == high else below(hi)
            if k < under_lo:
                high, upto = lo, under_lo
            elif k >= under_hi:
                low, under = hi, under_hi
            else:
                return float(v)
        if upto - under == inside:  # what is left agrees up to rounding
            return float(drawn[int(at)])
    found = between(None)
    return float(found[min(max(k - under, 0), len(found) - 1)])
