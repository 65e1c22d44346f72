"""Numpy over one block of a series, for what tasks do with many parameters or on streams."""

from __future__ import annotations

import numpy as np

#: Errors that are smoothed in one piece.
PIECE = 256


def smoothed(errors: np.ndarray, span: float, before: float | None = None) -> np.ndarray:
    """Exponentially weighted means of errors, going on from the one before; without one, the first error is the first mean."""
    alpha = 2 / (span + 1)
    q, made = 1 - alpha, []
    for k in range(0, len(errors), PIECE):
        x = alpha * errors[k : k + PIECE]
        if before is None:
            x[0], before = errors[0], 0.0
        if q > 0:
            powers = q ** np.arange(len(x))
            x = np.cumsum(x / powers) * powers + before * q * powers
        made.append(x)
        before = float(x[-1])
    return np.concatenate(made) if made else errors


def limits(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the up to `window` values before each, nan for the first."""
    k = np.arange(len(values))
    low = np.maximum(k - window, 0)
    centre = values.mean() if len(values) else 0.0
    c = values - centre
    one, two = (np.concatenate(([0.0], np.cumsum(x))) for x in (c, c * c))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (one[k] - one[low]) / (k - low)
        deviation = np.sqrt(np.maximum((two[k] - two[low]) / (k - low) - mean * mean, 0.0))
    return centre + mean, deviation


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of stretches of true flags."""
    change = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return change[::2], change[1::2]


def long_runs(flags: np.ndarray, least: int) -> np.ndarray:
    """The flags without stretches shorter than so many."""
    starts, ends = runs(flags)
    keep = ends - starts >= least
    steps = np.zeros(len(flags) + 1, np.int8)
    steps[starts[keep]] = 1
    steps[ends[keep]] -= 1
    return np.cumsum(steps[:-1]).astype(bool)
