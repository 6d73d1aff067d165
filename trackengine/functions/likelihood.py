"""Maximum-likelihood estimates of each kind of distribution from weighted values."""

from __future__ import annotations

import math

import numpy as np

from .binning import adaptive_bins
from .distributions import Distribution, log_density

#: Newton steps at most, and the relative change that ends them.
STEPS, SMALL = 200, 1e-12
#: Shapes stay between these: beyond, a gamma or negative binomial density can't be told from its limit.
LEAST, MOST = 1e-8, 1e10


def digamma(x) -> np.ndarray:
    """Derivative of log gamma for x > 0: by recurrence up to 8, then its asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 8).any():
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    s = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))


def trigamma(x) -> np.ndarray:
    """Second derivative of log gamma for x > 0."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (small := x < 8).any():
        out = np.where(small, out + 1 / np.where(small, x, 1) ** 2, out)
        x = np.where(small, x + 1, x)
    s = 1 / (x * x)
    return out + 1 / x + 0.5 * s + s / x * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s * (1 / 30 - s * 5 / 66))))


def _positive_root(slope, curve, at: float) -> float:
    """A zero of a decreasing function of a positive number, by Newton steps on its logarithm, inside a bracket."""
    low, high = math.log(LEAST), math.log(MOST)
    u = min(max(math.log(at), low), high)
    for _ in range(STEPS):
        a = math.exp(u)
        f = slope(a)
        low, high = (u, high) if f > 0 else (low, u)
        d = curve(a) * a
        new = u - f / d if d < 0 else (low + high) / 2
        if not low < new < high:
            new = (low + high) / 2
        if abs(new - u) < SMALL:
            return math.exp(new)
        u = new
    return math.exp(u)


def _gamma(x, w, p) -> tuple[float, float]:
    """Shape and rate: log(shape) - digamma(shape) = log(mean) - mean(log)."""
    mean, logs = float((w * x).sum()), float((w * np.log(x)).sum())
    gap = math.log(mean) - logs
    if gap <= 1e-14:  # all values are equal
        return MOST, MOST / mean
    start = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    shape = _positive_root(lambda a: math.log(a) - float(digamma(a)) - gap, lambda a: 1 / a - float(trigamma(a)), start)
    return shape, shape / mean


def _beta(x, w, p) -> tuple[float, float]:
    """Newton steps on both parameters' logarithms, shortened until the likelihood gains."""
    a_log, b_log = float((w * np.log(x)).sum()), float((w * np.log1p(-x)).sum())
    m = float((w * x).sum())
    v = max(float((w * (x - m) ** 2).sum()), 1e-12)
    size = max(m * (1 - m) / v - 1, 1e-3)
    at = np.log([max(m * size, LEAST), max((1 - m) * size, LEAST)])

    def value(u):
        a, b = np.exp(u)
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * a_log + (b - 1) * b_log

    for _ in range(STEPS):
        a, b = np.exp(at)
        g = np.array([a_log, b_log]) + digamma(a + b) - digamma([a, b])
        h = trigamma(a + b) * np.ones((2, 2)) - np.diag(trigamma([a, b]))
        scale = np.array([a, b])
        h = h * np.outer(scale, scale) + np.diag(g * scale)
        g = g * scale
        step = np.linalg.solve(h, -g) if np.linalg.eigvalsh(h).max() < 0 else g
        size = 1.0
        while size > 1e-10 and (np.abs(at + size * step).max() > math.log(MOST) or value(at + size * step) < value(at)):
            size /= 2
        at = at + size * step
        if np.abs(size * step).max() < SMALL or size <= 1e-10:
            break
    return tuple(map(float, np.exp(at)))


def _negative_binomial(x, w, p) -> tuple[float, float]:
    """Size r and success probability mean / (mean + r); without more variance than a Poisson's the size is the largest."""
    x = np.round(x)
    mean = float((w * x).sum())
    if mean == 0:
        return float(p[0]), 0.0
    slope = lambda r: float((w * digamma(x + r)).sum() - digamma(r)) + math.log(r / (r + mean))
    curve = lambda r: float((w * trigamma(x + r)).sum() - trigamma(r)) + 1 / r - 1 / (r + mean)
    v = float((w * (x - mean) ** 2).sum())
    if v <= mean:
        return MOST, mean / (mean + MOST)
    r = _positive_root(slope, curve, max(mean * mean / (v - mean), 1e-3))
    return r, mean / (mean + r)


def _normal(x, w, p) -> tuple[float, float]:
    mean = float((w * x).sum())
    return mean, max(math.sqrt(float((w * (x - mean) ** 2).sum())), LEAST)


def _categorical(x, w, p) -> tuple[float, ...]:
    return tuple(float(w[x == i].sum()) for i in range(1, len(p) + 1))


#: Estimates from values with weights that sum to one, and the parameters so far.
_ESTIMATES = {
    "poisson distribution": lambda x, w, p: (float((w * x).sum()),),
    "geometric distribution": lambda x, w, p: (1 / (1 + float((w * x).sum())),),
    "exponential distribution": lambda x, w, p: (1 / max(float((w * x).sum()), 1 / MOST),),
    "normal distribution": _normal,
    "gamma distribution": _gamma,
    "beta distribution": _beta,
    "negative binomial distribution": _negative_binomial,
    "categorical distribution": _categorical,
}
#: Where values must be for the estimate to see them; of others the density is 0 or infinite.
_INSIDE = {"gamma distribution": lambda x: x > 0, "beta distribution": lambda x: (x > 0) & (x < 1)}


def estimated(part: Distribution, x, w) -> Distribution:
    """The distribution of the kind of `part` that weighted values have the greatest likelihood of.

    x: values, w: their weights (not negative, of any sum). Without weight the part stays as it is. A delta has nothing to learn;
    a nonparametric part gets its density anew, in as many bins as it has; translated and log-transformed parts, products and
    mixtures are estimated inside (a mixture by one step of expectation-maximisation; a product from rows of values). Other
    kinds are an error.
    """
    kind, p = part.name.split(":")[-1], part.parameters
    x, w = np.asarray(x, float), np.asarray(w, float)
    if kind == "scalar id":
        return Distribution(part.name, p, tuple(estimated(c, x[:, i], w) for i, c in enumerate(part.parts)))
    if kind == "delta distribution" or not (w > 0).any():
        return part
    x, w = x[w > 0], w[w > 0]
    if kind == "pdf translation":
        return Distribution(part.name, p, (estimated(part.parts[0], x + p[0], w),))
    if kind == "pdf log transform":
        there = x + p[0] > 0
        return Distribution(part.name, p, (estimated(part.parts[0], np.log(x[there] + p[0]), w[there]),))
    if kind == "mixture distribution":
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.array([log_density(c)(x) for c in part.parts]) + np.log(np.array(p, float))[:, None]
            total = np.logaddexp.reduce(logs)
            share = np.exp(logs - np.where(np.isfinite(total), total, 0)) * w
        return Distribution(part.name, tuple((share.sum(axis=1) / share.sum()).tolist()), tuple(estimated(c, x, s) for c, s in zip(part.parts, share)))
    if kind == "nonparametric distribution":
        return nonparametric(x, w, len(p["X"]), part.name)
    if kind not in _ESTIMATES:
        raise ValueError(f"no estimate is known for {part.name!r}")
    if kind in _INSIDE:
        there = _INSIDE[kind](x)
        x, w = x[there], w[there]
        if not len(x):
            return part
    return Distribution(part.name, _ESTIMATES[kind](x, w / w.sum(), p), part.parts)


def nonparametric(x, w, bins: int, name: str = "scalar:nonparametric distribution", by_size: bool = True) -> Distribution:
    """An adaptive density of weighted values: see estimate.adaptive_bins() and estimate.density(), whose rules these are."""
    values, at = np.unique(x, return_inverse=True)
    edges, mass = (np.array(c) for c in adaptive_bins(values.tolist(), np.bincount(at, w).tolist(), bins, by_size))
    gaps = np.diff(edges)
    width = np.concatenate([gaps, gaps[-1:] if len(gaps) else [1.0]])
    logs = np.log(mass) - math.log(mass.sum() + 1) - np.log(width)
    return Distribution(name, {"X": edges.tolist(), "Y": logs.tolist()})


