"""Distribution trees as JSON documents give them, and their densities, means and logarithms."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

INF = float("inf")


@dataclass(frozen=True)
class Distribution:
    """A node {Name, Parameters, Distributions} of a model document."""

    name: str
    parameters: object = ()
    parts: tuple["Distribution", ...] = field(default=())

    @classmethod
    def from_json(cls, doc: dict) -> "Distribution":
        p = doc.get("Parameters")
        return cls(doc["Name"], p if isinstance(p, dict) else tuple(p or ()), tuple(cls.from_json(d) for d in doc.get("Distributions") or ()))

    def to_json(self) -> dict:
        p = self.parameters
        return {"Name": self.name, "Parameters": p if isinstance(p, dict) else list(p), "Distributions": [d.to_json() for d in self.parts] or None}


def _lgamma(x) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def _ln(x: float) -> float:
    return math.log(x) if x > 0 else -INF


def _times_ln(x: np.ndarray, p: float) -> np.ndarray:
    """x ln(p), nothing where x is 0."""
    return np.where(x > 0, np.where(x > 0, x, 1.0) * _ln(p), 0.0)


def _power_ln(x: np.ndarray, power: float) -> np.ndarray:
    """power ln(x), 0 for a power of 0 whatever x is; at 0 infinite with the sign that the power gives."""
    with np.errstate(divide="ignore"):
        return np.zeros_like(x) if power == 0 else power * np.log(x)


def _on(f, there):
    """f where `there` holds, -inf elsewhere; NaN stays NaN."""

    def run(x):
        x = np.atleast_1d(np.asarray(x, float))
        ok = there(x)
        out = np.where(np.isnan(x), np.nan, -INF)
        if ok.any():
            out[ok] = f(x[ok])
        return out

    return run


def _whole(x: np.ndarray) -> np.ndarray:
    return (x >= 0) & (x == np.floor(x))


def _negative_binomial(x: np.ndarray, size, prob: float) -> np.ndarray:
    return _lgamma(x + size) - _lgamma(size) - _lgamma(x + 1) + size * _ln(prob) + _times_ln(x, 1 - prob)


def _steps(d: Distribution):
    """A step function: edges X, log densities Y; the last step is as wide as the one before it, a single one 1 wide."""
    edges, logs = (np.asarray(d.parameters[k], float) for k in ("X", "Y"))
    end = edges[-1] + (edges[-1] - edges[-2] if len(edges) > 1 else 1.0)
    return _on(lambda x: logs[np.searchsorted(edges, x, side="right") - 1], lambda x: (x >= edges[0]) & (x < end))


def log_density(d: Distribution):
    """The log density as a function of an array of numbers. The names are those of the model documents.

    Of a product (`vector:scalar id`, `matrix:vector id`) it is a function of an array of vectors, a row for each.
    """
    kind, p = d.name.split(":")[-1], d.parameters
    if kind in ("scalar id", "vector id"):
        parts, sizes = [log_density(c) for c in d.parts], [dimension(c) for c in d.parts]
        bounds = np.concatenate([[0], np.cumsum(sizes)])

        def product(x):
            x = np.atleast_2d(np.asarray(x, float))
            if x.shape[1] != bounds[-1]:
                raise ValueError(f"{d.name} is of {bounds[-1]} numbers, not of {x.shape[1]}")
            return sum(f(x[:, a] if kind == "scalar id" else x[:, a:b]) for f, a, b in zip(parts, bounds, bounds[1:]))

        return product
    if kind == "delta distribution":
        return _on(np.zeros_like, lambda x: x == p[0])
    if kind == "poisson distribution":
        return _on(lambda x: _times_ln(x, p[0]) - p[0] - _lgamma(x + 1), _whole)
    if kind == "geometric distribution":
        return _on(lambda x: _ln(p[0]) + _times_ln(x, 1 - p[0]), _whole)
    if kind == "exponential distribution":
        return _on(lambda x: _ln(p[0]) - p[0] * x, lambda x: x >= 0)
    if kind == "gamma distribution":
        return _on(lambda x: p[0] * _ln(p[1]) - math.lgamma(p[0]) + _power_ln(x, p[0] - 1) - p[1] * x, lambda x: x >= 0)
    if kind == "beta distribution":
        return _on(lambda x: math.lgamma(p[0] + p[1]) - math.lgamma(p[0]) - math.lgamma(p[1]) + _power_ln(x, p[0] - 1) + _power_ln(1 - x, p[1] - 1), lambda x: (x >= 0) & (x <= 1))
    if kind == "normal distribution":
        return _on(lambda x: -0.5 * ((x - p[0]) / p[1]) ** 2 - math.log(p[1]) - 0.5 * math.log(2 * math.pi), np.isfinite)
    if kind == "categorical distribution":
        logs = np.array([_ln(w) for w in p])
        return _on(lambda x: logs[x.astype(int) - 1], lambda x: (x >= 1) & (x <= len(p)) & (x == np.floor(x)))
    if kind == "negative binomial distribution":
        return _on(lambda x: _negative_binomial(np.round(x), p[0], 1 - p[1]), lambda x: np.round(x) >= 0)
    if kind == "nonparametric distribution":
        return _steps(d)
    if kind == "pdf translation":
        inner = log_density(d.parts[0])
        return lambda x: inner(np.atleast_1d(x) + p[0])
    if kind == "pdf log transform":
        inner = log_density(d.parts[0])
        return _on(lambda x: inner(np.log(x + p[0])) - np.log(x + p[0]), lambda x: x + p[0] > 0)
    if kind == "mixture distribution":
        inner = [log_density(c) for c in d.parts]
        return lambda x: np.logaddexp.reduce([f(x) + _ln(w) for f, w in zip(inner, p)])
    raise ValueError(f"no density of one number is known for {d.name!r}")


def dimension(d: Distribution) -> int:
    """How many numbers an observation has: 1, or those of all factors of a product."""
    kind = d.name.split(":")[-1]
    if kind in ("scalar id", "vector id"):
        return sum(map(dimension, d.parts))
    return dimension(d.parts[0]) if kind == "mixture distribution" and d.parts else 1


def negative_binomial_r_log_density(d: Distribution):
    """The variant whose size is the second number of each observation: log density of (count, size) rows."""
    p = d.parameters

    def run(rows):
        x, r = np.asarray(rows, float).reshape(-1, 2).T
        count = np.round(x + p[1])
        with np.errstate(invalid="ignore"):
            return _on(lambda i: _negative_binomial(count[i.astype(int)], r[i.astype(int)], 1 - p[0]), lambda i: count[i.astype(int)] >= 0)(np.arange(len(x)))

    return run


def mean(d: Distribution):
    """Mean, or what stands for it in reports: lists for products and mixtures; None for a delta."""
    kind, p = d.name.split(":")[-1], d.parameters
    if kind in ("scalar id", "vector id", "mixture distribution"):
        return [mean(c) for c in d.parts]
    simple = {
        "beta distribution": lambda: p[0] / (p[0] + p[1]), "poisson distribution": lambda: p[0], "categorical distribution": lambda: p[0], "exponential distribution": lambda: p[0],
        "gamma distribution": lambda: p[0] / p[1], "geometric distribution": lambda: (1 - p[0]) / p[0], "negative binomial distribution": lambda: p[0], "negative binomial r distribution": lambda: p[0],
        "normal distribution": lambda: p[0], "pdf translation": lambda: mean(d.parts[0]), "pdf log transform": lambda: mean(d.parts[0]), "delta distribution": lambda: None,
    }
    return simple[kind]()


def delta(x: float) -> Distribution:
    return Distribution("scalar:delta distribution", (x,))


def poisson(rate: float) -> Distribution:
    return Distribution("scalar:poisson distribution", (rate,))


def geometric(p: float) -> Distribution:
    return Distribution("scalar:geometric distribution", (p,))


def normal(mean: float, deviation: float) -> Distribution:
    return Distribution("scalar:normal distribution", (mean, deviation))


def exponential(rate: float) -> Distribution:
    return Distribution("scalar:exponential distribution", (rate,))


def gamma(shape: float, rate: float) -> Distribution:
    return Distribution("scalar:gamma distribution", (shape, rate))


def translation(inner: Distribution, by: float) -> Distribution:
    return Distribution("scalar:pdf translation", (by,), (inner,))


def mixture(weights, parts) -> Distribution:
    return Distribution("scalar:mixture distribution", tuple(weights), tuple(parts))


def product(parts) -> Distribution:
    """A vector of independent numbers."""
    return Distribution("vector:scalar id", (), tuple(parts))


def rows(parts) -> Distribution:
    """A matrix of independent rows, each a vector's distribution."""
    return Distribution("matrix:vector id", (), tuple(parts))


#: Names that model documents may use, to a check of the document.
REGISTRY = {"scalar:" + n for n in ("delta distribution", "poisson distribution", "geometric distribution", "exponential distribution", "gamma distribution", "beta distribution", "normal distribution", "categorical distribution", "negative binomial distribution", "pdf translation", "pdf log transform", "mixture distribution", "nonparametric distribution")} | {"vector:scalar id", "matrix:vector id", "vector:mixture distribution", "matrix:mixture distribution"}


def unknown_names(d: Distribution) -> set[str]:
    """Names anywhere in a model that no density is known for."""
    return {d.name} - REGISTRY | {n for part in d.parts for n in unknown_names(part)}
