"""One series' state between micro-batches: scoring and drift of all new values at once, in numpy."""

from __future__ import annotations

import numpy as np

from ..functions import kernels
from ..functions.kernels import PIECE
from ..operators.drift import FLOOR, areas


class OnlineScorer:
    """One series' scoring state: the last inputs, the smoothed error, the last smoothed errors and the length of the run of flags that is open. Its results equal the batch scorer's in strict mode."""

    def __init__(self, inputs: int, span: int, window: int, z: float, least_run: int, state: tuple | None = None):
        self.inputs, self.span, self.window, self.z, self.least_run = inputs, span, window, z, least_run
        values, smoothed, ring, flags = state or ([], None, [], 0)
        self.values, self.smoothed, self.ring, self.flags = np.array(values, float), smoothed, np.array(ring, float), int(flags)

    def state(self) -> tuple:
        return self.values.tolist(), self.smoothed, self.ring.tolist(), self.flags

    def reset(self) -> None:
        self.values, self.smoothed, self.ring, self.flags = np.zeros(0), None, np.zeros(0), 0

    def prime(self, values) -> None:
        """Start anew from past values: they fill the inputs, and are scored without a result, so that thresholds are there at once."""
        self.reset()
        self.run(np.asarray(values, float))

    def run(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(prediction, smoothed, threshold, predicted) of new values in order, nan where there is none yet."""
        n, first = len(values), max(0, self.inputs - len(self.values))
        prediction, smoothed, threshold, predicted = (np.full(n, np.nan) for _ in range(4))
        if n > first:
            prediction[first:] = np.concatenate((self.values[-1:] if len(self.values) else [np.nan], values[:-1]))[first:]
            made = smoothed[first:] = kernels.smoothed(np.abs(prediction[first:] - values[first:]), self.span, self.smoothed)
            self.smoothed = float(made[-1])
            known = np.concatenate((self.ring, made))
            skip = max(0, self.window - len(self.ring))  # errors before there are as many as the window holds
            if len(made) > skip:
                frames = np.lib.stride_tricks.sliding_window_view(known, self.window)[len(self.ring) + skip - self.window :][: len(made) - skip]
                limits = [f.mean(axis=1) + self.z * f.std(axis=1) for f in (frames[k : k + PIECE] for k in range(0, len(frames), PIECE))]
                threshold[first + skip :] = np.concatenate(limits)
            place = np.arange(len(made))
            below = np.maximum.accumulate(np.where(made > threshold[first:], -1, place))
            run = np.where(below < 0, place + 1 + self.flags, place - below)
            predicted[first:], self.flags = run >= self.least_run, int(run[-1])
            self.ring = known[-self.window :]
        self.values = np.concatenate((self.values, values))[-self.inputs :]
        return prediction, smoothed, threshold, predicted == 1

    def step(self, value: float) -> tuple[float | None, float | None, float | None, bool]:
        """One value's results, None where there is none yet."""
        *numbers, predicted = (x[0] for x in self.run(np.array([value], float)))
        return (*(None if np.isnan(x) else float(x) for x in numbers), bool(predicted))


class Reference:
    """A reference sample, sorted, with running sums: where a value lies in it, and its inverse distribution's integral at n levels."""

    def __init__(self, values: np.ndarray):
        self.x = np.sort(values)
        self.sums, self.spread = np.concatenate(([0.0], np.cumsum(self.x))), float(self.x.std()) if len(self.x) else 0.0

    def located(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the sample lie at or below each value, and their sum."""
        below = np.searchsorted(self.x, values, "right")
        return below, self.sums[below]

    def curve(self, n: int) -> np.ndarray:
        level = np.arange(n + 1) * len(self.x)
        whole = level // n
        return (self.sums[whole] + (level / n - whole) * np.append(self.x, 0.0)[whole]) / len(self.x)

    def scores(self, values: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """The distance of the n values up to and with each of the ends from the sample, over its deviation; each value is located once, whatever the number of windows it lies in."""
        if not len(self.x) or n < 1:
            return np.zeros(len(ends))
        below, sums = self.located(values)
        curve, out = self.curve(n), np.zeros(len(ends))
        for k in range(0, len(ends), PIECE):
            frame = ends[k : k + PIECE, None] - n + 1 + np.arange(n)
            frame = np.take_along_axis(frame, np.argsort(values[frame], axis=1), 1)
            out[k : k + PIECE] = areas(values[frame], below[frame], sums[frame], len(self.x), curve).sum(axis=1)
        return out / max(self.spread, FLOOR)
