"""Bounded least-squares fits of curves: one curve a group, or a warm-started sweep over the rings of a sequence."""

from __future__ import annotations

import ast
import math
import operator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Hint, Model

RESULT = "seq_id string, bin int, k double, success boolean, params map<string,double>, stderr map<string,double>, chisqr double, redchi double, n_points int, n_free int, varied array<string>, covariance array<array<double>>"
#: Cosine between residuals and a slope at most, where a fit has settled.
SETTLED = 1e-4
#: Damping at the start of a descent, the next where the best before it has not settled or lies at a bound; part of the foretold gain that a step must bring.
DAMPS, WORTH = (1e-3, 1.0, 100.0), 1e-3
_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.USub: operator.neg, ast.UAdd: operator.pos}
_CALLS = {"exp": math.exp, "log": math.log, "sqrt": math.sqrt, "abs": abs, "min": min, "max": max}


def evaluate(expr: str, names: dict[str, float]) -> float:
    """Arithmetic on parameter names; nothing else is allowed."""

    def walk(n: ast.AST) -> float:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return float(n.value)
        if isinstance(n, ast.Name) and n.id in names:
            return names[n.id]
        if isinstance(n, ast.BinOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](walk(n.left), walk(n.right))
        if isinstance(n, ast.UnaryOp) and type(n.op) in _OPS:
            return _OPS[type(n.op)](walk(n.operand))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _CALLS and not n.keywords:
            return _CALLS[n.func.id](*map(walk, n.args))
        raise ValueError(f"not an arithmetic expression of known parameters: {expr}")

    return walk(ast.parse(expr, mode="eval").body)


def least_squares(model: Model, x: np.ndarray, y: np.ndarray, hints: dict[str, Hint], weights: np.ndarray | None = None, steps: int = 400) -> tuple[dict[str, float], dict[str, float], bool, dict]:
    """(values, standard errors, success, statistics): damped Gauss-Newton with the bounds kept by projection; errors scaled by the reduced chi square.

    ``success`` means that the sum of squares settled and its gradient there, but for parameters that their bounds hold, is finite and ``SETTLED`` of the slopes' and
    residuals' own size at most. Statistics: chisqr, redchi, n_points, n_free, varied (the free parameters) and their covariance. A parameter given by an expression has the error that
    the covariance of the free ones gives it.
    """
    free = [p for p, h in hints.items() if h.vary and h.expr is None]
    low, high = (np.array([getattr(hints[p], side) for p in free], float) for side in ("min", "max"))
    now = np.clip(np.array([hints[p].value for p in free], float), low, high)

    def values(v: np.ndarray) -> dict[str, float]:
        out = {p: h.value for p, h in hints.items()} | dict(zip(free, v.tolist(), strict=True))
        for p, h in hints.items():
            if h.expr is not None:
                out[p] = evaluate(h.expr, out)
        return out

    def off(v: np.ndarray) -> np.ndarray:
        r = model(x, **values(v)) - y
        return r if weights is None else r * weights

    def slopes(v: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(free)))
        for j in range(len(free)):
            h = 1e-7 * max(abs(v[j]), 1e-4)
            h = -h if v[j] + h > high[j] else h
            moved = v.copy()
            moved[j] += h
            out[:, j] = (off(moved) - r) / h
        return out

    def descend(now: np.ndarray, damp: float) -> tuple[np.ndarray, np.ndarray, float, bool, bool]:
        """(values, slopes, sum of squares, success, whether a parameter lies at a bound) where the descent from ``now`` ends; the damping follows how near a step's gain comes to the linear model's."""
        r = off(now)
        finite = bool(np.isfinite(r).all())
        cost, grow, success, settled = float(r @ r), 2.0, finite and not free, False
        for _ in range(steps if finite and free else 0):
            j = slopes(now, r)
            g = j.T @ r
            active = ((now <= low) & (g > 0)) | ((now >= high) & (g < 0))
            a = j.T @ j
            d = np.maximum(np.diag(a), 1e-30)
            moved = False
            for _ in range(24):
                m = a + damp * np.diag(d)
                m[active], m[:, active] = 0, 0
                m[active, active] = 1
                try:
                    step = np.linalg.solve(m, np.where(active, 0, -g))
                except np.linalg.LinAlgError:
                    damp, grow = damp * grow, grow * 2
                    continue
                then = np.clip(now + step, low, high)
                r2 = off(then)
                c2 = float(r2 @ r2)
                # Of the linear model along the step as the bounds leave it.
                told = cost - float(np.square(r + j @ (then - now)).sum())
                if np.isfinite(c2) and c2 < cost and cost - c2 >= WORTH * told:
                    gain, size = cost - c2, np.abs(then - now).max() / max(1e-12, np.abs(now).max())
                    damp = max(damp * max(1 / 5, 1 - (2 * gain / max(gain, told) - 1) ** 3), 1e-12)
                    now, r, cost, grow, moved = then, r2, c2, 2.0, True
                    break
                damp, grow = damp * grow, grow * 2
            if not moved or (gain <= 1e-14 * max(cost, 1e-300) and size < 1e-9):
                settled = True
                break
        j = slopes(now, r) if free else np.zeros((len(x), 0))
        g = j.T @ r
        held = ((now <= low) & (g > 0)) | ((now >= high) & (g < 0))
        if settled:
            # Against rounding: the residuals' own size, or that of the data where the model meets them.
            size = np.sqrt(cost) + 1e-8 * float(np.linalg.norm(y if weights is None else y * weights))
            success = bool(np.isfinite(j).all() and np.isfinite(cost) and (np.abs(g) <= SETTLED * np.linalg.norm(j, axis=0) * size + 1e-300)[~held].all())
        return now, j, cost, success, bool(((now <= low) | (now >= high)).any())

    start = now
    now, j, cost, success, at_bound = descend(start, DAMPS[0])
    for damp in DAMPS[1:] if free and np.isfinite(cost) else ():
        if success and not at_bound:
            break
        # Long steps may end in a valley without a floor or at a bound where the model is flat: again, with shorter ones. A fit that settled comes before one that did not.
        other = descend(start, damp)
        if (other[3], -other[2]) > (success, -cost):
            now, j, cost, success, at_bound = other
    err = {p: math.nan for p in hints}
    redchi = cost / max(1, len(x) - len(free))
    cov = np.full((len(free), len(free)), math.nan)
    try:
        cov = np.linalg.inv(j.T @ j) * redchi
        err |= dict(zip(free, np.sqrt(np.maximum(np.diag(cov), 0)).tolist(), strict=True))
        for p in (p for p, h in hints.items() if h.expr is not None):
            slope = []
            for k in range(len(free)):
                h = 1e-6 * max(abs(now[k]), 1e-4)
                up, down = (values(now + np.eye(len(free))[k] * s)[p] for s in (h, -h))
                slope.append((up - down) / (2 * h))
            err[p] = math.sqrt(max(0.0, float(np.array(slope) @ cov @ np.array(slope)))) if free else math.nan
    except np.linalg.LinAlgError:
        pass
    return values(now), err, success, {"chisqr": cost, "redchi": redchi, "n_points": len(x), "n_free": len(free), "varied": free, "covariance": cov.tolist()}


def simple_estimates(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Starting values for A, B, tau of a simple structure function; B is the quadratic's value in the middle of the first five points."""
    b = max(float(np.polynomial.Polynomial.fit(x[:5], y[:5], deg=2).coef[0]), 0.0)
    a = max(float(y[-1]) - b, 0.0)
    return {"A": a, "B": b, "tau": float(x[np.argmin(np.abs((y - b) / a - 0.5))]) if a > 0 else 1.0}


def estimates(curves: DataFrame, value: str = "d") -> DataFrame:
    """seq_id, bin, A, B, tau: starting values of every curve by ``simple_estimates``; NaN for curves that begin with NaN or have under 5 points."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tau")
        x, y = pdf["tau"].to_numpy(float), pdf[value].to_numpy(float)
        found = simple_estimates(x, y) if len(y) >= 5 and np.isfinite(y).all() else dict.fromkeys(("A", "B", "tau"), math.nan)
        return pd.DataFrame([{"seq_id": pdf["seq_id"].iloc[0], "bin": pdf["bin"].iloc[0], **found}])

    return curves.groupBy("seq_id", "bin").applyInPandas(one, "seq_id string, bin int, A double, B double, tau double")


def fit_curves(curves: DataFrame, model: Model, value: str = "d", params: dict[str, Hint] | None = None, estimate_simple_parameters: bool = False, use_err: bool = False) -> DataFrame:
    """fit_params, every curve (seq_id, bin) on its own: parallel over all of them."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tau")
        x, y = pdf["tau"].to_numpy(float), pdf[value].to_numpy(float)
        return pd.DataFrame([_row(pdf, *_fit_one(model, x, y, params, estimate_simple_parameters, 1 / pdf["err"].to_numpy(float) if use_err else None))])

    return curves.groupBy("seq_id", "bin").applyInPandas(one, RESULT)


def _fit_one(model: Model, x: np.ndarray, y: np.ndarray, params: dict[str, Hint] | None, estimate: bool, weights: np.ndarray | None) -> tuple[dict, dict, bool, dict]:
    if np.isnan(y[0]):
        nothing = {p: math.nan for p in model.params}
        return nothing, nothing, False, {}
    hints = dict(model.hints)
    if estimate:
        hints |= {p: replace(hints[p], value=v) for p, v in simple_estimates(x, y).items() if p in hints}
    return least_squares(model, x, y, hints | (params or {}), weights)


def _row(pdf: pd.DataFrame, values: dict, err: dict, success: bool, statistics: dict) -> dict:
    about = {"chisqr": math.nan, "redchi": math.nan, "n_points": len(pdf), "n_free": 0, "varied": [], "covariance": []} | statistics
    return {"seq_id": pdf["seq_id"].iloc[0], "bin": int(pdf["bin"].iloc[0]), "k": float(pdf["k"].iloc[0]), "success": success, "params": values, "stderr": err, **about}


def fit_multik(curves: DataFrame, model: Model, ref: int, value: str = "d", ref_params: dict[str, Hint] | None = None, use_err: bool = False, fixed_params: dict[str, list[float]] | None = None, fixed_params_min: dict[str, list[float]] | None = None, fixed_params_max: dict[str, list[float]] | None = None, fixed_params_expr: dict[str, list[str]] | None = None) -> DataFrame:
    """fit_params with warm starts: the ring of index ``ref`` first, then downward from it, then upward (with it again).

    Each fit starts from the last optimum, so a sequence is one group; sequences run in parallel. Rings that begin with NaN give NaN. ``use_err`` weighs by
    1 / err in the sweeps, not in the first fit. The fixed_* lists have a value for each ring.
    """

    def at(hints: dict[str, Hint], i: int) -> dict[str, Hint]:
        out = dict(hints)
        for given, change in ((fixed_params, lambda h, v: replace(h, value=v, vary=False)), (fixed_params_min, lambda h, v: replace(h, min=v)), (fixed_params_max, lambda h, v: replace(h, max=v)), (fixed_params_expr, lambda h, v: replace(h, expr=v))):
            for p, v in (given or {}).items():
                out[p] = change(out[p], v[i])
        return out

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [g.sort_values("tau") for _, g in pdf.groupby("bin", sort=True)]
        rows: list[dict | None] = [None] * len(rings)

        def solve(i: int, hints: dict[str, Hint], weigh: bool) -> dict[str, float]:
            g = rings[i]
            x, y = g["tau"].to_numpy(float), g[value].to_numpy(float)
            if np.isnan(y[0]):
                nothing = {p: math.nan for p in model.params}
                rows[i] = _row(g, nothing, nothing, False, {})
                return {p: h.value for p, h in hints.items()}
            w = 1 / g["err"].to_numpy(float) if weigh and g["err"].notna().all() else None
            found = least_squares(model, x, y, at(hints, i), w)
            rows[i] = _row(g, *found)
            return found[0]

        base = dict(model.hints) | (ref_params or {})
        start = solve(ref, base, False)
        for order in (range(ref - 1, -1, -1), range(ref, len(rings))):
            last = start
            for i in order:
                last = solve(i, {p: replace(h, value=last[p]) for p, h in base.items()}, use_err)
        return pd.DataFrame(rows)

    return curves.groupBy("seq_id").applyInPandas(one, RESULT)


def wide(fits: DataFrame, model: Model) -> DataFrame:
    """One column a parameter and one for its error, then success and k."""
    cols = [F.col("params")[p].alias(p) for p in model.params] + [F.col("stderr")[p].alias(f"{p}_stderr") for p in model.params]
    return fits.select("seq_id", "bin", *cols, "success", "k")


def evaluate_model(curves: DataFrame, model: Model, column: str = "model", **params) -> DataFrame:
    """Adds the model's value at tau, as an expression."""
    return curves.withColumn(column, model.column(F.col("tau"), **params))
