"""Statistics of a growing past at all rows of many keys at once, as arrays: what ``accumulate`` says row by row.

Rows come in order of key and time, so what has matured at a row is a range of rows before it. Counts are differences of running sums;
a percentile of a range is found bit by bit of its place among the distinct values (a wavelet matrix, whose levels are used as they are made).
"""

from __future__ import annotations

import numpy as np

from tidemark.operators.accumulate import DAY, MONTH


def kth(values: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of values[low:high], for many ranges; k is less than high - low. NaN is the largest."""
    known, codes = np.unique(values, return_inverse=True)
    codes, low, high, k = codes.astype(np.int32), low.astype(np.int32), high.astype(np.int32), k.astype(np.int32)
    found = np.zeros(len(k), np.int32)
    for bit in reversed(range(int(len(known) - 1).bit_length())):
        zero = (codes >> bit & 1) == 0
        zeros = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(zero, out=zeros[1:])
        low_zeros, high_zeros = zeros[low], zeros[high]
        here = high_zeros - low_zeros
        up = k >= here
        k = np.where(up, k - here, k)
        low, high = np.where(up, low - low_zeros + zeros[-1], low_zeros), np.where(up, high - high_zeros + zeros[-1], high_zeros)
        found += up.astype(np.int32) << bit
        codes = np.concatenate([codes[zero], codes[~zero]])
    return known[found]


def percentiles_of(values: np.ndarray, low: np.ndarray, high: np.ndarray, p: float) -> np.ndarray:
    """Linearly interpolated percentiles of values[low:high] for ranges in order; of nothing it is 0."""
    if not len(values):
        return np.zeros(len(low))
    # Rows between two arrivals ask for the same range.
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    a, b = low[fresh], high[fresh]
    out, some = np.zeros(len(a)), b > a
    a, b = a[some], b[some]
    at = p * (b - a - 1)
    k = np.floor(at).astype(np.int64)
    after = np.flatnonzero((at != k) & (k + 1 < b - a))
    both = kth(values, np.concatenate([a, a[after]]), np.concatenate([b, b[after]]), np.concatenate([k, k[after] + 1]))
    x = both[: len(a)].astype(float)
    x[after] += (both[len(a) :] - x[after]) * (at - k)[after]
    out[some] = x
    return out[np.cumsum(fresh) - 1]


def growing(key: np.ndarray, t: np.ndarray, timed: np.ndarray, ret: np.ndarray, mfe: np.ndarray, mae: np.ndarray, valid: np.ndarray, sequence: np.ndarray, horizon: int) -> list[np.ndarray]:
    """Columns of ``Accumulator.SCHEMA``: at each row, of the rows of its key with a time up to its own less the horizon.

    Equal keys stand together, in order of t; rows that aren't timed come first, have no past and are in none.
    """
    n = len(key)
    places = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    untimed = np.concatenate([[0], np.cumsum(~timed)])
    first = (starts + untimed[ends] - untimed[starts])[group] if n else starts
    # Times as their places among all, from 1, so that key and time are one number.
    times = np.unique(t[timed])
    width = len(times) + 1
    at = group * width + np.where(timed, np.searchsorted(times, t) + 1, 0)
    upto = np.where(timed, np.searchsorted(at, group * width + np.searchsorted(times, t - horizon, "right"), "right"), first)

    def counts(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        running = np.concatenate([[0], np.cumsum(flags)])
        return running[first], running[upto]

    def count(flags: np.ndarray) -> np.ndarray:
        a, b = counts(flags)
        return b - a

    def last(running: np.ndarray) -> np.ndarray:
        return np.where(upto > first, running[upto - 1], 0)

    def new(x: np.ndarray) -> np.ndarray:
        return (places == first) | np.concatenate([[True], x[1:] != x[:-1]])[:n]

    by_sequence = np.lexsort((sequence, timed, group))
    s, g, k = sequence[by_sequence], group[by_sequence], timed[by_sequence]
    unseen = np.zeros(n, bool)
    unseen[by_sequence] = np.concatenate([[True], (s[1:] != s[:-1]) | (g[1:] != g[:-1]) | (k[1:] != k[:-1])])[:n]
    new_month = new(t // MONTH)
    in_month = np.where(timed, places - np.maximum.accumulate(np.where(new_month, places, 0)) + 1, 0)
    top = np.maximum.accumulate(in_month + group * (n + 1)) - group * (n + 1)
    good = valid & timed
    sums = np.where(good, ret, 0.0)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        np.cumsum(sums[a:b], out=sums[a:b])
    ups, falls = good & (ret > 0), good & (ret < 0)
    drop, rise = np.where(mae < 0, -mae, 0.0), np.where(mfe > 0, mfe, 0.0)
    quantiles = [percentiles_of(x[side], *counts(side), p) for side, x, p in ((ups, mfe, 0.70), (ups, drop, 0.80), (falls, drop, 0.70), (falls, rise, 0.80))]
    return [upto - first, count(unseen), count(good), count(ups), last(sums), count(new(t // DAY)), count(new_month), last(top), quantiles[0], quantiles[1], count(falls), quantiles[2], quantiles[3]]
