"""Interpolating B-splines of small degree on one curve: not-a-knot ends, end pieces carried on outside."""

from __future__ import annotations

import numpy as np


def _basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """Values of all basis functions at x, one row per x, by the triangular recursion in each x's interval."""
    n = len(knots) - degree - 1
    at = np.clip(np.searchsorted(knots, x, "right") - 1, degree, n - 1)
    out = np.zeros((len(x), n))
    for row, (v, i) in enumerate(zip(x, at, strict=True)):
        b = [1.0]
        for d in range(1, degree + 1):
            lo = [knots[i + 1 - d + r] for r in range(d)]
            hi = [knots[i + 1 + r] for r in range(d)]
            share = [b[r] / (hi[r] - lo[r]) for r in range(d)]
            b = [(share[r] * (hi[r] - v) if r < d else 0.0) + (share[r - 1] * (v - lo[r - 1]) if r else 0.0) for r in range(d + 1)]
        out[row, i - degree : i + 1] = b
    return out


def interpolate(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """The spline of ``degree`` (2 or 3) through (x, y), at ``at``."""
    if len(x) <= degree:
        raise ValueError(f"a spline of degree {degree} needs more than {degree} points")
    if degree % 2:
        inner = x[(degree + 1) // 2 : len(x) - (degree + 1) // 2]
    else:
        middle = (x[1:] + x[:-1]) / 2
        inner = middle[degree // 2 : len(middle) - degree // 2]
    knots = np.r_[[x[0]] * (degree + 1), inner, [x[-1]] * (degree + 1)]
    return _basis(at, knots, degree) @ np.linalg.solve(_basis(x, knots, degree), y)


def weights(x: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """A row for each of ``at``: what the values at x weigh in the spline's value there, in log-log (the log of the value is the sum of weights times logs)."""
    x, at = np.log(np.asarray(x, float)), np.log(np.asarray(at, float))
    return np.array([interpolate(x, unit, at, degree) for unit in np.eye(len(x))]).T.reshape(len(at), len(x))


def loglog(x: np.ndarray, y: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.exp(interpolate(np.log(x), np.log(y), np.log(at), degree))
