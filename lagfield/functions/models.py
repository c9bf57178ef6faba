"""Fit models: one formula each, used with Spark columns and with numpy alike, and parameter hints."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = float(np.finfo(np.float64).eps)
_SPARK = SimpleNamespace(exp=F.exp, power=lambda a, b: F.pow(a, b if isinstance(b, Column) else F.lit(float(b))))
_NUMPY = SimpleNamespace(exp=np.exp, power=np.power)


@dataclass(frozen=True)
class Hint:
    value: float = 1.0
    min: float = -math.inf
    max: float = math.inf
    vary: bool = True
    expr: str | None = None


@dataclass(frozen=True)
class Model:
    name: str
    formula: Callable
    hints: dict[str, Hint] = field(default_factory=dict)

    @property
    def params(self) -> list[str]:
        return list(self.hints)

    def column(self, x: Column, **p) -> Column:
        """The model as a Spark expression; parameters are numbers or columns."""
        return self.formula(_SPARK, x, SimpleNamespace(**{k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in p.items()}))

    def __call__(self, x: np.ndarray, **p: float) -> np.ndarray:
        with np.errstate(all="ignore"):
            return self.formula(_NUMPY, np.asarray(x, float), SimpleNamespace(**p))


def _stretched(m, x, p):
    return p.A * m.exp(-m.power(p.Gamma * x, p.beta))


def _double(m, x, p):
    one, two = m.exp(-m.power(p.Gamma1 * x, p.beta1)), m.exp(-m.power(p.Gamma2 * x, p.beta2))
    return p.A * (p.alpha * one + (1 - p.alpha) * two)


def _schulz(m, x, p):
    s2 = p.sigma * p.sigma
    return p.A * m.power(1 + s2 * p.Gamma * x, -1.0 / s2)


def _structure(isf: Callable) -> Callable:
    """A (1 - f) + B with f of amplitude 1."""
    return lambda m, x, p: p.A * (1 - isf(m, x, SimpleNamespace(**{**vars(p), "A": 1.0}))) + p.B


_A, _G, _B = Hint(1.0, EPS), Hint(1.0, EPS), Hint(0.0)
_BETAS = {"generic": Hint(1.0, EPS), "simple": Hint(1.0, vary=False), "stretched": Hint(1.0, EPS, 1.0), "compressed": Hint(1.0, 1.0)}
_SIGMAS = {"flory_schulz": Hint(1.0, EPS, 1.0), "exponential_distribution": Hint(1.0, vary=False)}
_TWO = {"A": _A, "Gamma1": _G, "beta1": _BETAS["generic"], "Gamma2": _G, "beta2": _BETAS["generic"], "alpha": Hint(1.0, 0.0, 1.0)}


def _registry() -> dict[str, Model]:
    out: dict[str, Model] = {}
    for name, beta in _BETAS.items():
        hints = {"A": _A, "Gamma": _G, "beta": beta}
        out[f"{name}_exponential_isf"] = Model(f"{name}_exponential_isf", _stretched, hints)
        out[f"{name}_exponential"] = Model(f"{name}_exponential", _structure(_stretched), hints | {"B": _B})
    out["double_exponential_isf"] = Model("double_exponential_isf", _double, _TWO)
    out["double_exponential"] = Model("double_exponential", _structure(_double), _TWO | {"B": _B})
    for name, sigma in _SIGMAS.items():
        hints = {"A": _A, "Gamma": _G, "sigma": sigma}
        out[f"{name}_isf"] = Model(f"{name}_isf", _schulz, hints)
        out[name] = Model(name, _structure(_schulz), hints | {"B": _B})
    out["simple_exp"] = Model("simple_exp", lambda m, x, p: p.amplitude * m.exp(-x / p.tau), {"tau": Hint(1.0, 0.0), "amplitude": Hint(1.0, 0.0, 2.0)})
    out["simple_structure_function"] = Model("simple_structure_function", lambda m, x, p: p.A * (1 - m.exp(-x / p.tau)) + p.B, {"A": Hint(1.0, 0.0), "B": Hint(0.0, 0.0), "tau": Hint(1.0, 0.0)})
    return out


MODELS = _registry()
