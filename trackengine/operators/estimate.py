"""Models of bin values: weighted histograms, adaptive densities, mixtures by expectation-maximisation."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackengine.functions.binning import adaptive_bins
from trackengine.functions.distributions import INF, Distribution, delta, dimension, geometric, log_density, poisson
from trackengine.functions.likelihood import estimated

#: Distinct values beyond which a histogram is first rounded to a grid.
MAX_BINS = 1_000_000


def value_histogram(df: DataFrame, value: str = "value", *by: str) -> DataFrame:
    """(by…, x, n): how often each exact value occurs, NaN and null apart."""
    return df.filter(~F.isnan(value) & F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("n"))


#: Log weights are added up in steps of this width, inside which no sum of exponentials overflows.
WEIGHT_STEP = 256.0


def weighted_histogram(df: DataFrame, value: str, log_weight: str) -> DataFrame:
    """(x, log_n): log of the summed weights of each value, from log weights; -inf adds nothing.

    Weights of a value are added up by steps of their logarithm, then the few steps of each value are: no row is joined back.
    """
    w, step = F.col("w"), F.floor(F.col("w") / WEIGHT_STEP)
    rows = df.filter(~F.isnan(value) & F.col(value).isNotNull()).select(F.col(value).alias("x"), F.when(F.col(log_weight) > -INF, F.col(log_weight)).alias("w"))
    parts = rows.groupBy("x", step.alias("step")).agg(F.sum(F.exp(w - F.floor(w / WEIGHT_STEP) * WEIGHT_STEP)).alias("part"))
    tops = parts.groupBy("x").agg(F.max("step").alias("top"), F.collect_list(F.struct("step", "part")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.coalesce(p["part"] * F.exp((p["step"] - F.col("top")) * WEIGHT_STEP), F.lit(0.0)))
    return tops.select("x", F.when(F.col("top").isNull(), F.lit(-INF)).otherwise(F.ln(total) + F.col("top") * WEIGHT_STEP).alias("log_n"))


def gridded(hist: DataFrame, max_bins: int = MAX_BINS, sums: list[str] | None = None) -> DataFrame:
    """A histogram of more than max_bins values with its values rounded down to a grid of as many steps, counts added.

    Infinite values stay as they are, and the grid is that of the finite ones. sums: the columns to add up, n by default.
    """
    names = sums or ["n"]
    finite = F.when(F.abs("x") < INF, F.col("x"))
    low, high, n = hist.agg(F.min(finite), F.max(finite), F.count("*")).first()
    if n <= max_bins or low is None or not 0 < (high - low) < INF:
        return hist
    step = (high - low) / max_bins
    x = F.when(F.abs("x") < INF, F.floor(F.col("x") / step) * step).otherwise(F.col("x"))
    return hist.groupBy(x.alias("x")).agg(*(F.sum(c).alias(c) for c in names))


def density(hist: DataFrame) -> DataFrame:
    """(x, delta, log_density) of a histogram (x, n) whose values are the bins' lower edges.

    A bin reaches to the next value, the last one as far as the one before it, a single one by 1. The total is the sum of
    the counts plus one, so the whole integrates to N / (N + 1). The histogram is one of distinct values, which the caller
    bounds (gridded, adaptive_bins); its edges are ordered in one task.
    """
    by, whole = Window.orderBy("x"), Window.partitionBy()
    step = F.lead("x").over(by) - F.col("x")
    rows = hist.select("x", "n", step.alias("step"))
    width = F.coalesce("step", F.lag("step").over(by), F.lit(1.0))
    rows = rows.select("x", "n", width.alias("delta"), F.sum("n").over(whole).alias("total"))
    return rows.select("x", "delta", (F.ln("n") - F.ln(F.col("total") + 1) - F.ln("delta")).alias("log_density"))


def log_entropy(dens: DataFrame) -> DataFrame:
    """(log_entropy): log of minus the sum of mass times log mass."""
    m = F.col("log_density") + F.ln("delta")
    return dens.agg(F.ln(-F.sum(F.exp(m) * m)).alias("log_entropy"))


def step_log_pdf(df: DataFrame, dens: DataFrame, value: str = "value") -> DataFrame:
    """df with log_pdf: the density of the bin that a value lies in, -inf outside; NaN and null values give null.

    Tasks hold the edges, sorted, and search a batch of values in them at once, so a row's cost grows with the logarithm of the edges'
    number. A density has as many as its histogram has values, which gridded() bounds; one of more is an error.
    """
    got = dens.select("x", "delta", "log_density").limit(MAX_BINS + 2).toArrow()
    if len(got) > MAX_BINS + 1:
        raise ValueError(f"the density has more than {MAX_BINS + 1} bins; put its histogram on a grid first")
    x, width, logs = (got.column(c).to_numpy().astype(float) for c in ("x", "delta", "log_density"))
    order = np.argsort(x)
    edges, logs = np.append(x[order], x[order][-1:] + width[order][-1:]), np.concatenate([[-INF], logs[order], [-INF]])

    @F.pandas_udf("double")
    def search(values: pd.Series) -> pd.Series:
        v = values.to_numpy(float, na_value=np.nan)
        at = np.searchsorted(edges, v, side="right") if len(edges) else np.zeros(len(v), int)
        return pd.Series(logs[np.minimum(at, len(logs) - 1)]).mask(np.isnan(v))

    v = F.col(value).cast("double")
    found = search(v)
    return df.withColumn("log_pdf", F.when(F.isnan(v) | v.isNull(), F.lit(None).cast("double")).otherwise(found))


# Mixtures ---------------------------------------------------------------------


@dataclass
class Fit:
    """A mixture in canonical order, its log-likelihood for each observation, and the steps taken."""

    model: Distribution
    log_likelihood: float
    steps: int


updated = estimated


def _steps_of(model: Distribution, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log densities of values under each component, weights included, and under the mixture."""
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.array([log_density(p)(x) for p in model.parts]) + np.log(np.array(model.parameters, float))[:, None]
        return logs, np.logaddexp.reduce(logs)


def fit_mixture(x, n, start: Distribution, eps: float = 1e-8, max_steps: int | None = None) -> Fit:
    """EM on a histogram of values x with counts n. It ends when the log-likelihood gains less than eps for each
    observation. x has one entry (of a product's mixture, one row) for each distinct value, however many observations there are.

    Components are of any kind that likelihood.estimated() knows; another kind is an error. Values that no component can have
    take no part, and the log-likelihood returned is then -inf; if there are no others, that is an error.
    """
    x, n = np.asarray(x, float), np.asarray(n, float)
    model, share, before, steps = start, n / n.sum(), -INF, 0
    while True:
        logs, total = _steps_of(model, x)
        now = float((share * np.where(share > 0, total, 0)).sum())
        if math.isnan(now):
            raise ValueError("the likelihood of the mixture is not a number")
        covered = np.isfinite(total) & (share > 0)
        if not covered.any():
            raise ValueError("no component of the mixture can have any of the values")
        of_covered = float((share * np.where(covered, total, 0)).sum())
        if of_covered - before < eps or (max_steps is not None and steps >= max_steps):
            break
        before, steps = of_covered, steps + 1
        resp = np.exp(logs - np.where(np.isfinite(total), total, 0)) * n * covered
        mass = resp.sum(axis=1)
        model = Distribution(start.name, tuple((mass / mass.sum()).tolist()), tuple(estimated(p, x, r) for p, r in zip(model.parts, resp)))
    return Fit(canonical(model), now, steps)


def _size(p: Distribution) -> tuple:
    """What components of a kind are ordered by: the inner ones' numbers for those that have parts."""
    if p.parts:
        return tuple(n for c in p.parts for n in _size(c))
    if isinstance(p.parameters, dict):
        return tuple(p.parameters["X"][:1])
    first = tuple(p.parameters[:1])
    return tuple(-v for v in first) if p.name.endswith(("geometric distribution", "exponential distribution")) else first


def canonical(model: Distribution) -> Distribution:
    """Components in an order that doesn't depend on start values: by kind as they came, then geometric and exponential ones by
    falling rate, others by rising first parameter, so that the heaviest tail is last."""
    kinds = list(dict.fromkeys(p.name for p in model.parts))
    order = sorted(range(len(model.parts)), key=lambda i: (kinds.index(model.parts[i].name), _size(model.parts[i])))
    return Distribution(model.name, tuple(model.parameters[i] for i in order), tuple(model.parts[i] for i in order))


def _spread(part: Distribution, at: float, low: float, high: float) -> Distribution:
    """A component of the same kind whose mean is `at`, for values between low and high."""
    kind, p = part.name.split(":")[-1], part.parameters
    span = max(high - low, 1e-6)
    new = {
        "poisson distribution": lambda: (max(at, 1e-3),), "geometric distribution": lambda: (1 / (1 + max(at, 1e-3)),), "exponential distribution": lambda: (1 / max(at, 1e-6),),
        "normal distribution": lambda: (at, span / 4), "gamma distribution": lambda: (2.0, 2.0 / max(at, 1e-6)), "negative binomial distribution": lambda: (2.0, max(at, 1e-3) / (max(at, 1e-3) + 2)),
    }
    if kind == "pdf translation":
        return Distribution(part.name, p, (_spread(part.parts[0], at + p[0], low + p[0], high + p[0]),))
    return Distribution(part.name, new[kind](), part.parts) if kind in new else part


def seeded_starts(x, n, start: Distribution, tries: int, seed: int = 0) -> list[Distribution]:
    """`tries` start models like the given one: it, then ones whose components have means drawn from the values by their
    counts, and weights drawn evenly. Kinds without a mean to set stay as they are."""
    x, n = np.asarray(x, float), np.asarray(n, float)
    finite = np.isfinite(x)
    x, n = x[finite], n[finite]
    rng = np.random.default_rng(seed)
    out = [start]
    for _ in range(tries - 1):
        # half of the means by counts, half anywhere, so that rare large values have a component now and then
        means = np.where(rng.random(len(start.parts)) < 0.5, rng.choice(x, len(start.parts), p=n / n.sum()), rng.uniform(x.min(), x.max(), len(start.parts)))
        weights = rng.dirichlet(np.full(len(start.parts), 2.0))
        out.append(Distribution(start.name, tuple(weights.tolist()), tuple(_spread(p, float(m), float(x.min()), float(x.max())) for p, m in zip(start.parts, means))))
    return out


def best_fit(x, n, start: Distribution, tries: int = 8, seed: int = 0, **options) -> Fit:
    """The fit of the greatest likelihood from several seeded starts; the first of equal ones."""
    fits = []
    for model in seeded_starts(x, n, start, tries, seed):
        try:
            fits.append(fit_mixture(x, n, model, **options))
        except ValueError:
            if model is start and tries == 1:
                raise
    if not fits:
        raise ValueError("no start model can have any of the values")
    return max(fits, key=lambda f: f.log_likelihood)


def fit_track(df: DataFrame, start: Distribution | Callable[[np.ndarray], Distribution], value: str = "value", tries: int = 1, seed: int = 0, **options) -> Fit:
    """Fit a mixture to the values of a table through their histogram, the only part that reaches the driver.

    start: the model to start from, or a function that makes it from the histogram's values, in rising order: a density of any
    form stays zero where its start has no step, so its steps must cover the values. tries: start models to try, the given
    one first (see seeded_starts).
    """
    hist = gridded(value_histogram(df, value)).toArrow().to_pandas().sort_values("x")
    start = start(hist["x"].to_numpy(float)) if callable(start) else start
    return best_fit(hist["x"], hist["n"], start, tries, seed, **options)


def posterior(df: DataFrame, model: Distribution, components: list[int], value: str = "value") -> DataFrame:
    """df with log_posterior: log probability that a value comes from one of the components (numbers from 0).

    Rows stay where they are; of each batch, the densities are evaluated once for each distinct value. NaN and null values,
    and those that no component has, give NaN.
    """
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        x, at = np.unique(values.to_numpy(float, na_value=np.nan), return_inverse=True)
        logs, total = _steps_of(model, x)
        with np.errstate(invalid="ignore"):
            out = np.logaddexp.reduce(logs[components], axis=0) - total
        return pd.Series(out[at])

    # evaluated once for each row: what filters and projects it again reads the column
    return df.withColumn("log_posterior", F.coalesce(run.asNondeterministic()(value), F.lit(float("nan"))))


# Vectors and coordinates ------------------------------------------------------


def vector_values(df: DataFrame, v: str = "v") -> DataFrame:
    """(value): all elements of all vectors, as observations of one distribution."""
    return df.select(F.explode(v).alias("value"))


def coordinate_histograms(df: DataFrame, v: str = "v") -> DataFrame:
    """(i, x, n): the histogram of each coordinate of vectors of one size."""
    return value_histogram(df.select(F.posexplode(v).alias("i", "value")), "value", "i")


def matrix_values(df: DataFrame, m: str = "m") -> DataFrame:
    """(value): all elements of all matrices, as observations of one distribution."""
    return df.select(F.explode(F.flatten(m)).alias("value"))


def matrix_row_histograms(df: DataFrame, m: str = "m") -> DataFrame:
    """(i, x, n): the histogram of each row (track) of matrices with one number of rows."""
    rows = df.select(F.posexplode(m).alias("i", "row")).select("i", F.explode("row").alias("value"))
    return value_histogram(rows, "value", "i")


def vector_histogram(df: DataFrame, v: str = "v") -> DataFrame:
    """(v, n): how often each exact vector occurs; vectors with a null or NaN are left out."""
    whole = F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return df.filter(whole).groupBy(F.col(v).alias("v")).agg(F.count("*").alias("n"))


#: Distinct vectors whose weights a task adds up at once.
TOGETHER = 65_536
#: Numbers in the distinct vectors of a table that are fitted by the driver.
FEW = 1 << 21


def joint_step(hist: DataFrame, model: Distribution) -> tuple[np.ndarray, float, list[pd.DataFrame]]:
    """One E-step over (v, n): each component's weight, the log-likelihood of the sum, and for each coordinate its values (x)
    with their weight in each component (c0, c1, …), on a grid where there are more than MAX_BINS.

    Vectors stay where they are; tasks add up a row for each distinct value of a coordinate.
    """
    k = len(model.parts)
    width = dimension(model)
    schema = f"i int, x double, {', '.join(f'c{c} double' for c in range(k))}"

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), TOGETHER):
                some = pdf.iloc[at : at + TOGETHER]
                x, n = np.array(some["v"].tolist(), float).reshape(len(some), -1), some["n"].to_numpy(float)
                if x.shape[1] != width:
                    raise ValueError(f"the model is of {width} numbers, not of {x.shape[1]}")
                logs, total = _steps_of(model, x)
                if np.isnan(total).any():
                    raise ValueError("the likelihood of the mixture is not a number")
                covered = np.isfinite(total)
                resp = np.exp(logs - np.where(covered, total, 0)) * n * covered
                whole = np.concatenate([resp.sum(axis=1)])
                # i = -1: the components' weights; -2: the log-likelihood and the weight of what is covered
                yield pd.DataFrame([[-1, 0.0, *whole]], columns=["i", "x", *(f"c{c}" for c in range(k))])
                yield pd.DataFrame([[-2, y, z, *[0.0] * (k - 1)] for y, z in ((0.0, float((n * np.where(covered, total, 0)).sum())), (1.0, float((n * covered).sum())), (2.0, float((n * ~covered).sum())))], columns=["i", "x", *(f"c{c}" for c in range(k))])
                for i in range(width):
                    values, where = np.unique(x[:, i], return_inverse=True)
                    yield pd.DataFrame({"i": i, "x": values, **{f"c{c}": np.bincount(where, r, len(values)) for c, r in enumerate(resp)}})

    cols = [f"c{c}" for c in range(k)]
    sums = hist.select("v", "n").mapInPandas(run, schema).groupBy("i", "x").agg(*(F.sum(c).alias(c) for c in cols))
    low, high, many = (F.min("x"), F.max("x"), F.count("*"))
    bounds = sums.groupBy("i").agg(low.alias("low"), high.alias("high"), many.alias("values"))
    step = (F.col("high") - F.col("low")) / MAX_BINS
    fine = (F.col("values") <= MAX_BINS) | F.isnan(step) | (F.abs(step) == INF) | (step == 0)
    grid = sums.join(F.broadcast(bounds), "i").groupBy("i", F.when(fine, F.col("x")).otherwise(F.floor(F.col("x") / step) * step).alias("x")).agg(*(F.sum(c).alias(c) for c in cols))
    got = grid.toArrow().to_pandas().sort_values(["i", "x"])  # MAX_BINS rows a coordinate at most
    if not len(got):
        raise ValueError("there are no vectors to fit")
    weight = got[got["i"] == -1][cols].to_numpy(float)[0]
    of_covered, covered, left = got[got["i"] == -2]["c0"].to_numpy(float)
    if not covered:
        raise ValueError("no component of the mixture can have any of the values")
    return weight, float(of_covered / (covered + left)), [got[got["i"] == i] for i in range(width)]


def _estimated_by_coordinate(part: Distribution, hist: list[pd.DataFrame], c: str) -> Distribution:
    """A product estimated from the weights of each of its coordinates' values."""
    kind = part.name.split(":")[-1]
    if kind not in ("scalar id", "vector id"):
        return estimated(part, hist[0]["x"], hist[0][c])
    at, parts = 0, []
    for inner in part.parts:
        parts.append(_estimated_by_coordinate(inner, hist[at : at + dimension(inner)], c))
        at += dimension(inner)
    return Distribution(part.name, part.parameters, tuple(parts))


def fit_joint(df: DataFrame, start: Distribution, v: str = "v", eps: float = 1e-8, max_steps: int | None = None) -> Fit:
    """One mixture of products for the vectors of a table: several tracks' values at a bin, or windows of them.

    EM over the distinct vectors. Where those have FEW numbers at most, they are fitted by the driver, as a track's histogram is. Of
    more, they stay in Spark, and a step sends each coordinate's values with their weights to the driver, from which components
    are estimated. Both end as fit_mixture() does.
    """
    hist = vector_histogram(df, v).persist()
    try:
        some = hist.limit(FEW // dimension(start) + 1).toArrow()
        if not len(some):
            raise ValueError("there are no vectors to fit")
        if len(some) <= FEW // dimension(start):
            x = some.column("v").to_pylist()
            if bad := {len(row) for row in x} - {dimension(start)}:
                raise ValueError(f"the model is of {dimension(start)} numbers, not of {min(bad)}")
            order = sorted(range(len(x)), key=x.__getitem__)
            return fit_mixture(np.array(x, float)[order], some.column("n").to_numpy()[order], start, eps, max_steps)
        model, before, steps = start, -INF, 0
        while True:
            weight, now, coordinates = joint_step(hist, model)
            if now - before < eps or (max_steps is not None and steps >= max_steps):
                return Fit(canonical(model), now, steps)
            before, steps = now, steps + 1
            parts = tuple(_estimated_by_coordinate(p, coordinates, f"c{c}") for c, p in enumerate(model.parts))
            model = Distribution(start.name, tuple((weight / weight.sum()).tolist()), parts)
    finally:
        hist.unpersist()


def vector_posterior(df: DataFrame, model: Distribution, components: list[int], v: str = "v") -> DataFrame:
    """df with log_posterior: log probability that a vector comes from one of the components of a mixture of products.

    NaN for vectors that are null, hold a null or NaN, or that no component has; another length than the model's is an error.
    """
    width = dimension(model)

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        out = np.full(len(values), np.nan)
        there = np.flatnonzero(values.notna().to_numpy())
        if len(there):
            if bad := {len(x) for x in values.iloc[there]} - {width}:
                raise ValueError(f"the model is of {width} numbers, not of {min(bad)}")
            logs, total = _steps_of(model, np.array([np.asarray(x, float) for x in values.iloc[there]]))
            with np.errstate(invalid="ignore"):
                out[there] = np.logaddexp.reduce(logs[components], axis=0) - total
        return pd.Series(out)

    return df.withColumn("log_posterior", F.coalesce(run(F.col(v).cast("array<double>")), F.lit(float("nan"))))


def vector_log_density(df: DataFrame, model: Distribution, v: str = "v", name: str = "log_pdf") -> DataFrame:
    """df with the log density of each vector, or of each matrix (an array of rows), under a product or a mixture of products.

    Another number of elements than the model's is an error; null arrays and those with a null or NaN give NaN.
    """
    f, width = log_density(model), dimension(model)
    nested = df.schema[v].dataType.elementType.typeName() == "array"
    flat = F.flatten(v) if nested else F.col(v)
    rows = len(model.parts[0].parts if model.name.split(":")[-1] == "mixture distribution" else model.parts)

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        out = np.full(len(values), np.nan)
        there = np.flatnonzero(values.notna().to_numpy())
        if len(there):
            if bad := {len(x) for x in values.iloc[there]} - {width}:
                raise ValueError(f"the model is of {width} numbers, not of {min(bad)}")
            x = np.array([np.asarray(x, float) for x in values.iloc[there]])
            with np.errstate(divide="ignore", invalid="ignore"):
                out[there] = f(x)
        return pd.Series(out)

    fits = (F.size(v) == rows) if nested and model.name.startswith("matrix") else F.lit(True)
    checked = F.when(fits | F.col(v).isNull(), flat).otherwise(F.raise_error(F.lit(f"a matrix has not {rows} rows")).cast("array<double>"))
    return df.withColumn(name, F.coalesce(run(checked.cast("array<double>")), F.lit(float("nan"))))


def fit_coordinates(df: DataFrame, start: Distribution, v: str = "v", max_bins: int = MAX_BINS, **options) -> list[Fit]:
    """A mixture for each coordinate, fitted where its histogram is; a row for each coordinate reaches the driver.

    Histograms of more than max_bins values are rounded to a grid first, as gridded() does, each to its own.
    """
    hist = coordinate_histograms(df, v)
    bounds = hist.groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("values"))
    step = (F.col("high") - F.col("low")) / max_bins
    fine = (F.col("values") <= max_bins) | F.isnan(step) | (F.abs(step) == INF)
    x = F.when(fine, F.col("x")).otherwise(F.floor(F.col("x") / step) * step)
    hist = hist.join(bounds, "i").groupBy("i", x.alias("x")).agg(F.sum("n").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        fit = fit_mixture(pdf["x"], pdf["n"], start, **options)
        return pd.DataFrame({"i": pdf["i"][:1], "model": [json.dumps(fit.model.to_json())], "log_likelihood": [fit.log_likelihood], "steps": [fit.steps]})

    rows = hist.groupBy("i").applyInPandas(run, "i int, model string, log_likelihood double, steps int").collect()
    return [Fit(Distribution.from_json(json.loads(r.model)), r.log_likelihood, r.steps) for r in sorted(rows, key=lambda r: r.i)]


def model_curves(hist: DataFrame, model: Distribution, foreground: list[int]) -> DataFrame:
    """(x, n, background, foreground): a model's two parts at the values of a histogram."""

    def run(frames):
        for pdf in frames:
            parts = np.array([w * np.exp(log_density(p)(pdf.x.to_numpy(float))) for w, p in zip(model.parameters, model.parts)]).reshape(len(model.parts), -1)
            fg = parts[foreground].sum(axis=0)
            yield pdf.assign(background=parts.sum(axis=0) - fg, foreground=fg)

    return hist.select("x", "n").mapInPandas(run, "x double, n long, background double, foreground double")
