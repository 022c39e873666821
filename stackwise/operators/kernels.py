"""Iterative per-position estimators, vectorised over positions.

A batch of sorted sample arrays becomes a matrix ``(positions, samples)``, padded at the end.  All sums run along the
samples in ascending order with compensation, so a result depends on its own samples only.
"""

from __future__ import annotations

import numpy as np

from stackwise.functions.student import esd_critical_value

EPSILON = 32 * np.finfo(np.float64).eps
#: Below this many samples the ESD test has no power and everything is kept.
ESD_LEAST = 15


def padded(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrix and the number of samples in each row."""
    n = np.diff(offsets)
    out = np.zeros((len(n), int(n.max(initial=0))))
    if out.size:
        out[np.arange(out.shape[1])[None, :] < n[:, None]] = values[offsets[0] : offsets[-1]]
    return out, n


def compensated(terms: np.ndarray) -> np.ndarray:
    """Compensated sum of each row, in order; padding must be 0."""
    total = np.zeros(len(terms))
    lost = np.zeros(len(terms))
    for k in range(terms.shape[1]):
        v = terms[:, k]
        new = total + v
        lost += np.where(np.abs(total) >= np.abs(v), (total - new) + v, (v - new) + total)
        total = new
    return total + lost


def moments(values: np.ndarray, held: np.ndarray, divisor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scale, mean and population sigma of the held samples of each row; mean and sigma in units of the scale."""
    scale = np.max(np.abs(np.where(held, values, 0.0)), axis=1, initial=0.0)
    safe, n = np.where(scale == 0, 1.0, scale), np.maximum(divisor, 1)
    unit = np.where(held, values, 0.0) / safe[:, None]
    mean = compensated(unit / n[:, None])
    low = np.min(np.where(held, unit, np.inf), axis=1, initial=np.inf)
    high = np.max(np.where(held, unit, -np.inf), axis=1, initial=-np.inf)
    mean = np.minimum(np.maximum(mean, low), high)
    apart = np.where(held, unit - mean[:, None], 0.0)
    sigma = np.sqrt(np.maximum(compensated(apart * apart / n[:, None]), 0.0))
    return safe, np.where(scale == 0, 0.0, mean), np.where(scale == 0, 0.0, sigma)


def strict_means(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    n = held.sum(axis=1)
    scale, mean, _ = moments(values, held, n)
    return np.where(n > 0, mean * scale + 0.0, np.nan)


def mean(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(len(n), np.int64)
    return strict_means(values, np.arange(values.shape[1])[None, :] < n[:, None]), none, none


def median(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle of each sorted row; of two middle ones their mean, without overflow."""
    none, row = np.zeros(len(n), np.int64), np.arange(len(n))
    if not values.shape[1]:
        return np.full(len(n), np.nan), none, none
    high = values[row, np.maximum(n // 2, 0) - (n == 0)]
    low = values[row, np.maximum(n // 2 - 1, 0)]
    with np.errstate(over="ignore"):
        even = np.where((low < 0) == (high < 0), low + (high - low) * 0.5, low * 0.5 + high * 0.5)
    return np.where(n % 2 == 1, high, even) + 0.0, none, none


def weighted_mean(values: np.ndarray, weights: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled by the largest magnitude and the largest weight, kept within the extremes."""
    none = np.zeros(len(n), np.int64)
    held = np.arange(values.shape[1])[None, :] < n[:, None]
    scale = np.max(np.abs(np.where(held, values, 0.0)), axis=1, initial=0.0)
    heavy = np.max(np.where(held, weights, 0.0), axis=1, initial=0.0)
    safe = np.where(scale == 0, 1.0, scale)[:, None]
    part = np.where(held, weights, 0.0) / np.where(heavy == 0, 1.0, heavy)[:, None] / np.maximum(n, 1)[:, None]
    bottom = compensated(part)
    ratio = compensated(part * (np.where(held, values, 0.0) / safe)) / np.where(bottom == 0, 1.0, bottom)
    unit = values / safe
    low = np.min(np.where(held, unit, np.inf), axis=1, initial=np.inf)
    high = np.max(np.where(held, unit, -np.inf), axis=1, initial=-np.inf)
    out = np.where(scale == 0, 0.0, np.minimum(np.maximum(ratio, low), high) * scale + 0.0)
    return np.where(n > 0, out, np.nan), none, none


def percentile_clip(values: np.ndarray, n: np.ndarray, low: float, high: float, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without shares of the lowest and highest samples; a row that would keep under ``floor`` keeps all."""
    under, over = np.floor(n * low).astype(np.int64), np.floor(n * high).astype(np.int64)
    enough = n - under - over >= np.minimum(floor, n)
    under, over = np.where(enough, under, 0), np.where(enough, over, 0)
    place = np.arange(values.shape[1])[None, :]
    return strict_means(values, (place >= under[:, None]) & (place < (n - over)[:, None])), under, over


def linear_fit_clip(values: np.ndarray, n: np.ndarray, low: float, high: float, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the samples that lie far from one line through the sorted samples over their ranks.

    The rank coordinate is symmetric around 0, so slope and intercept are independent sums.
    """
    place = np.arange(values.shape[1])[None, :]
    held, count = place < n[:, None], np.maximum(n, 1)[:, None]
    scale = np.max(np.abs(np.where(held, values, 0.0)), axis=1, initial=0.0)
    unit = np.where(held, values, 0.0) / np.where(scale == 0, 1.0, scale)[:, None]
    rank = np.where(held, (2 * place + 1 - n[:, None]) / count, 0.0)
    width = compensated(rank * rank / count)
    slope = compensated(unit * rank / count) / np.where(width == 0, 1.0, width)
    line = compensated(unit / count)[:, None] + slope[:, None] * rank
    apart = np.where(held, unit - line, 0.0)
    sigma = np.sqrt(np.maximum(compensated(apart * apart / count), 0.0))
    sigma = np.where((sigma <= EPSILON) | (n < 3) | (scale == 0), 0.0, sigma)
    some = (sigma > 0)[:, None] & held
    under, over = some & (apart < (-low * sigma)[:, None]), some & (apart > (high * sigma)[:, None])
    kept = held & ~under & ~over
    enough = (kept.sum(axis=1) >= np.minimum(floor, n))[:, None]
    under, over, kept = under & enough, over & enough, np.where(enough, kept, held)
    return strict_means(values, kept), under.sum(axis=1), over.sum(axis=1)


def sigma_clip(values: np.ndarray, n: np.ndarray, low_sigma: float, high_sigma: float, passes: int, floor: int, winsorised: bool) -> np.ndarray:
    """Which samples are kept: an interval of each sorted row that shrinks until nothing changes.

    A pass that would leave fewer than ``floor`` samples is discarded whole and ends the row.
    """
    place = np.arange(values.shape[1])[None, :]
    low, high = np.zeros(len(n), np.int64), n.astype(np.int64).copy()
    going = n > 0
    for _ in range(passes):
        going = going & (high - low > floor)
        if not going.any():
            break
        held = (place >= low[:, None]) & (place < high[:, None])
        if winsorised:
            bottom = values[np.arange(len(n)), np.minimum(low, values.shape[1] - 1)]
            top = values[np.arange(len(n)), np.maximum(high - 1, 0)]
            inside = np.clip(values, bottom[:, None], top[:, None])
            scale, mean, sigma = moments(inside, place < n[:, None], n)
        else:
            scale, mean, sigma = moments(values, held, high - low)
        going = going & (sigma != 0)
        unit = values / scale[:, None]
        under = (held & (unit < (mean - low_sigma * sigma)[:, None])).sum(axis=1)
        upto = (held & (unit <= (mean + high_sigma * sigma)[:, None])).sum(axis=1)
        new_low, new_high = low + under, low + upto
        going = going & (new_high - new_low >= floor) & ((new_low != low) | (new_high != high))
        low, high = np.where(going, new_low, low), np.where(going, new_high, high)
    return (place >= low[:, None]) & (place < high[:, None])


def generalized_esd(values: np.ndarray, n: np.ndarray, fraction: float, significance: float, floor: int) -> np.ndarray:
    """Dispositions of each sorted sample: 0 kept, -1 rejected low, 1 rejected high.

    Two-sided test: the sample farthest from the mean is taken out again and again; all taken out up to the last whose
    residual exceeded its bound are rejected.
    """
    rows, width = values.shape
    out = np.zeros((rows, width), np.int8)
    most = np.minimum(np.floor(n * fraction).astype(np.int64), np.maximum(0, n - floor))
    most[n < ESD_LEAST] = 0
    held = np.arange(width)[None, :] < n[:, None]
    taken = np.full((rows, int(most.max(initial=0))), -1)
    side = np.zeros(taken.shape, np.int8)
    last = np.zeros(rows, np.int64)
    going = most > 0
    for step in range(taken.shape[1]):
        going = going & (step < most) & (held.sum(axis=1) >= 3)
        at = np.flatnonzero(going)
        if not len(at):
            break
        part, mask = values[at], held[at]
        count = mask.sum(axis=1)
        scale = np.max(np.abs(np.where(mask, part, 0.0)), axis=1)
        safe = np.where(scale == 0, 1.0, scale)
        unit = np.where(mask, part, 0.0) / safe[:, None]
        mean = compensated(unit / count[:, None])
        apart = np.where(mask, unit - mean[:, None], 0.0)
        deviation = np.sqrt(np.maximum(compensated(apart * apart), 0.0) / (count - 1))
        good = (scale > 0) & (deviation > EPSILON)
        farthest = np.argmax(np.where(mask, np.abs(apart), -1.0), axis=1)  # of equals the first, on the low side
        residual = apart[np.arange(len(at)), farthest]
        bound = np.array([esd_critical_value(int(c), significance) for c in count])
        statistic = np.abs(residual) / np.where(deviation == 0, 1.0, deviation)
        going[at[~good]] = False
        at, farthest, residual = at[good], farthest[good], residual[good]
        taken[at, step] = farthest
        side[at, step] = np.where(residual < 0, -1, 1)
        held[at, farthest] = False
        beyond = (statistic > bound)[good]
        last[at[beyond]] = step + 1
    for step in range(taken.shape[1]):
        at = np.flatnonzero(step < last)
        out[at, taken[at, step]] = side[at, step]
    return out
