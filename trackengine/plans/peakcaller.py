"""Whole jobs: learn mixtures from tracks, score tracks by them, call peaks on the scores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackengine.functions.distributions import Distribution, delta, geometric, mixture, poisson, translation
from trackengine.operators.estimate import Fit, fit_track, posterior
from trackengine.operators.peaks import peaks
from trackengine.operators.track import KEYS, Track, combine


def treatment_start(seed_rates=(2.0, 0.3, 0.05)) -> Distribution:
    """Zeros, a Poisson and two geometric components."""
    a, b, c = seed_rates
    return mixture([0.25] * 4, [delta(0.0), poisson(a), geometric(b), geometric(c)])


def control_start() -> Distribution:
    """Point masses at the small counts, a shifted Poisson and geometric components."""
    return mixture([1 / 9] * 9, [*(delta(float(i)) for i in range(5)), translation(poisson(3.0), -5.0), geometric(0.3), geometric(0.1), geometric(0.02)])


def learn(track: Track, start: Distribution, eps: float = 1e-8, names: list[str] | None = None, max_steps: int | None = None, tries: int = 1) -> Fit:
    """Fit a mixture to the values of a track, or of some of its sequences; with several tries the best of seeded starts."""
    return fit_track((track.filter_genome(names) if names else track).df, start, tries=tries, eps=eps, max_steps=max_steps)


def score(track: Track, model: Distribution, components: list[int]) -> Track:
    """The probability of each bin's value to come from the components."""
    df = posterior(track.df, model, components)
    return replace(track, df=df.select(*KEYS, F.exp("log_posterior").alias("value")))


def treatment_against_control(treatment: Track, control: Track) -> Track:
    """Probable in the treatment and not so in the control."""
    return combine([treatment, control], lambda a, b: a * (1 - b))


def call_peaks(track: Track, model: Distribution, components: list[int], threshold: float = 0.95, wsize: int = -1) -> DataFrame:
    return peaks(score(track, model, components), threshold, wsize)
